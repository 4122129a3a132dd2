"""URL filtering with redirect equivalence.

Explicit rules come first: a rule fits its host and all subdomains if the path starts with its
path, and the longest fitting rule wins; of equal rules an allow. URLs without a rule take the
decision of their aliases: addresses that are declared to redirect to each other or that name
each other as canonical. Aliases are the connected components of these edges and of no others.
Within a component an explicit allow overrides any block; a component without a decision is
allowed.

Edges join addresses. URLs are one address if they differ only in the case of scheme or host, in
the fragment, or in the slash of an empty path; a query, a scheme or ``.html`` tells them apart.
Pages may declare several links; relative ones are resolved against the first ``<base href>``,
or else the url, of their page.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, fits no rule
and is allowed; equal URLs are judged once and share their verdict; declared links that are empty,
of a scheme without ``//`` (``mailto:``), or relative on a page without an absolute url are
ignored, as are known links that lack ``://``; input columns named like an output column are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.llm.components import components
from stallworks.llm.text import lower_ascii
from stallworks.operators.ranking import written

# (verdict, host, path)
Rule = tuple[str, str, str]

_CANONICAL = r"(?i)<link\b[^>]*\brel=[\"']?canonical\b[^>]*>"
_REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*>"
_BASE = r"(?i)<base\b[^>]*\bhref=[^>]*>"
_HREF = r"(?i)\bhref=[\"']?([^\"'\s>]+)"
_TARGET = r"(?i)\burl=[\"']?([^\"'\s>;]+)"


def _after_scheme(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    start = F.locate("://", text)
    return F.when(start > 0, F.substring(text, start + 3, F.length(text))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What edges join: the URL without fragment, scheme and host in lower case; NULL without ``://``."""
    at = F.locate("://", url)
    path = path_of(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(
        at > 0,
        F.concat(
            lower_ascii(F.substring(url, F.lit(1), at + 2)),
            host_of(url),
            F.when(path == "", F.lit("/")).otherwise(path),
            query,
        ),
    )


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, with its ``.`` and ``..`` segments carried out."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    closing = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), closing)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as an address with ``://``, seen from ``base``; NULL where there is none."""
    scheme = F.regexp_extract(base, r"^([^/?#]*:)//", 1)
    site = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*([^?#]*/)?", 1)
    named = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.regexp_extract(target, r"[?#].*", 0)
    rooted = F.when(named.startswith("/"), named).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), named)
    )
    whole = F.when(named == "", path).otherwise(_without_dots(rooted))
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[^/?#]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(site == "", F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .otherwise(F.concat(site, whole, rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Redirect and canonical edges ``(url, target)`` that the pages themselves declare."""

    def declared(tag: str, target: str) -> Column:
        return F.transform(
            F.regexp_extract_all("html", F.lit(tag), F.lit(0)),
            lambda found: F.regexp_extract(found, target, 1),
        )

    named = F.regexp_extract(F.regexp_extract("html", _BASE, 0), _HREF, 1)
    targets = F.concat(declared(_CANONICAL, _HREF), declared(_REFRESH, _TARGET))
    return (
        pages.select("url", F.explode(targets).alias("target"), named.alias("named"))
        .select("url", "target", F.coalesce(resolved(F.col("url"), F.col("named")), "url").alias("base"))
        .select("url", resolved(F.col("base"), F.col("target")).alias("target"))
        .where("target IS NOT NULL")
    )


def with_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Distinct ``(url, host, path)`` with the rule and verdict of the longest fitting rule.

    Rules are joined on the host suffixes of a URL, so a long list costs no more per URL.
    """
    spark = urls.sparkSession
    listed = spark.createDataFrame(
        [(verdict, host, path, host + path) for verdict, host, path in rules],
        "rule_verdict string, rule_host string, rule_path string, rule string",
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = (
        urls.where("host <> ''")
        .select("url", "path", F.explode(suffixes).alias("rule_host"))
        .join(listed, "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
    )
    best = fitting.groupBy("url").agg(
        F.max(
            F.struct(
                F.length("rule").alias("n"),
                "rule",
                (F.col("rule_verdict") == "allow").alias("allows"),
                "rule_verdict",
            )
        ).alias("best")
    )
    return urls.join(
        best.select(
            "url", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")
        ),
        "url",
        "left",
    )


def url_verdicts(
    pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None
) -> DataFrame:
    """Pages with ``host``, ``path``, ``rule`` and ``verdict``.

    ``links`` holds known redirect edges ``(url, target)``; those the pages declare in
    ``html`` are added if that column is there.
    """
    # Written, as several plans below read the links: pages are searched for tags once.
    declared = written(page_links(pages)) if "html" in pages.columns else None
    edges = [df.select("url", "target") for df in (links, declared) if df is not None]
    named = pages.select("url")
    graph = None
    if edges:
        graph = edges[0]
        for more in edges[1:]:
            graph = graph.unionAll(more)
        named = named.unionAll(graph.select("url")).unionAll(graph.select("target"))
    urls = (
        named.where(F.col("url").isNotNull())
        .distinct()
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    )
    ruled = with_rules(urls, rules).withColumn("address", address_of(F.col("url")))
    if graph is None:
        grouped = ruled.withColumn("component", F.col("address"))
    else:
        found = components(
            graph.select(
                address_of(F.col("url")).alias("a"), address_of(F.col("target")).alias("b")
            )
        )
        grouped = ruled.join(found, F.col("address") == F.col("id"), "left").withColumn(
            "component", F.coalesce("component", "address")
        )
    decided = (
        grouped.where("rule_verdict IS NOT NULL AND component IS NOT NULL")
        .groupBy("component")
        .agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allowed"))
        .withColumnRenamed("component", "__component")
    )
    judged = grouped.join(decided, F.col("component") == F.col("__component"), "left").select(
        F.col("url").alias("__url"),
        "rule",
        F.coalesce(
            "rule_verdict", F.when(F.col("allowed") == 0, F.lit("block")).otherwise("allow")
        ).alias("verdict"),
    )
    own = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in own]
    return (
        pages.select(*kept)
        .join(judged, F.col("url") == F.col("__url"), "left")
        .select(
            *kept,
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            "rule",
            F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        )
    )
