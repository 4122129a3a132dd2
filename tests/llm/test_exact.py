"""Operators with one right answer, against brute force and SQL, and their edge cases."""

from __future__ import annotations

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stallworks.llm import decontamination, queries, statements
from stallworks.llm.components import components
from stallworks.llm.decontamination import MASKS, SHORTEST_ITEM, WINDOW, decontaminated, overlaps
from stallworks.llm.mixing import fair_mix
from stallworks.llm.near_dedup import deduplicated, near_duplicates
from stallworks.llm.substring_dedup import copied_factors, removed_spans, without_repeats
from stallworks.llm.url_filter import url_verdicts
from tests.compare import connect, difference
from tests.llm import reference

TEXTS = "doc_id long, text string, source string, size long, bands string, lead string"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """Documents with further columns that are named like columns an operator makes."""
    return spark.createDataFrame([(d, t, None, 7, "b", "l") for d, t in rows], TEXTS)


@pytest.mark.parametrize("name", sorted(statements.STATEMENTS))
def test_sql(spark, check_dir, name):
    con = connect(check_dir)
    result = queries.QUERIES[name](spark, check_dir)
    assert difference(result, con, statements.STATEMENTS[name]) is None


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n)]


def changed(rng: random.Random, w: list[str], n: int) -> list[str]:
    out = list(w)
    for place in rng.sample(range(len(out)), min(n, len(out))):
        out[place] = f"new{rng.random()}"
    return out


@pytest.fixture(scope="module")
def corpus() -> list[tuple[int, str | None]]:
    """Copies, near copies at every distance, shared passages, empty and tiny texts."""
    rng, vocab = random.Random(5), vocabulary(5)
    base = [rng.choices(vocab, k=rng.choice([30, 80, 200])) for _ in range(25)]
    passage = rng.choices(vocab, k=70)
    rows: list[list[str]] = [list(b) for b in base]
    for i in range(60):
        rows.append(changed(rng, base[i % 5], i // 4))
    for i in range(25):
        at = rng.randint(0, 20)
        rows.append(base[i][:at] + passage[i % 10 :] + base[i][at:])
    texts: list[str | None] = [" ".join(w) for w in rows]
    texts += [texts[0], texts[0].upper(), texts[3].replace(" ", "\n "), None, "", " \t", "one", "one"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, corpus, k):
    got = {r.doc_id: r for r in near_duplicates(clashing(spark, corpus), k=k).collect()}
    want = reference.groups([d for d, _ in corpus], reference.near_links(corpus, k, 80))
    assert {d: r.component_id for d, r in got.items()} == want
    for d, text in corpus:
        assert got[d].n_shingles == len(reference.shingle_set(text, k))
        assert got[d].kept == (want[d] == d)
    kept = deduplicated(clashing(spark, corpus), k=k)
    assert kept.columns == ["doc_id", "text", "source", "size", "bands", "lead"]
    assert {r.doc_id for r in kept.collect()} == {d for d in want if want[d] == d}


def test_near_duplicate_links_beyond_the_leader(spark):
    """Chains whose ends are not similar, and a bucket whose leader is linked to nobody."""
    rng, vocab = random.Random(8), vocabulary(8)
    w = rng.choices(vocab, k=120)
    rows, chain = [], list(w)
    for i in range(30):
        rows.append((100 - i, " ".join(chain)))
        chain = changed(rng, chain, 5)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows)).collect()}
    assert got == reference.groups([d for d, _ in rows], reference.near_links(rows, 5, 80))


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C d e f"),
            (3, None), (4, "")]
    got = sorted(map(tuple, near_duplicates(table(spark, rows)).collect()), key=repr)
    assert got == sorted(
        [(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False),
         (3, 0, 3, True), (4, 0, 4, True)],
        key=repr,
    )
    assert near_duplicates(table(spark, [])).count() == 0
    assert deduplicated(table(spark, rows)).count() == 5


@pytest.mark.parametrize("window", [50, 12])
def test_substrings(spark, corpus, window):
    got = {r.doc_id: r for r in removed_spans(clashing(spark, corpus), window=window).collect()}
    want = reference.cut_words(corpus, window)
    assert len(got) == len(corpus)
    for d, (kept, gone) in want.items():
        assert (got[d].n_words, got[d].n_removed) == (len(gone), sum(gone))
        assert got[d].kept_sha256 == reference.sha256(kept)
    texts = {r.doc_id: r.text for r in without_repeats(clashing(spark, corpus), window=window).collect()}
    for d, text in corpus:
        kept, gone = want[d]
        assert texts[d] == (" ".join(kept) if any(gone) else text)


def test_substring_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (5, long), (5, long), (5, other), (7, long), (8, None), (9, ""),
            (10, "x " + other)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in removed_spans(table(spark, rows)).collect()), key=repr)
    assert got == sorted(
        [(None, 60, 0), (5, 60, 0), (5, 60, 0), (5, 60, 0), (7, 60, 60), (8, 0, 0), (9, 0, 0),
         (10, 61, 60)],
        key=repr,
    )
    assert removed_spans(table(spark, [])).count() == 0
    assert without_repeats(table(spark, rows)).count() == len(rows)


def test_masks_reach_every_window_with_two_substitutions():
    for places in itertools.combinations(range(WINDOW), 2):
        assert any(
            not {at + m for m in mask} & set(places)
            for mask in MASKS
            for at in range(WINDOW - mask[-1])
        )


def test_masks_reach_every_short_item_with_one_substitution():
    for n in range(SHORTEST_ITEM, WINDOW):
        for place in range(n):
            assert any(
                place not in {at + m for m in mask} for mask in MASKS for at in range(n - mask[-1])
            ), (n, place)


def test_short_items_with_any_one_word_substituted(spark):
    """In mid-text, where no seed of a document ends with the item."""
    items = [(n, " ".join(f"i{n}w{at}" for at in range(n))) for n in range(SHORTEST_ITEM, WINDOW)]
    docs = []
    for n, text in items:
        for place in range(n):
            w = text.split()
            w[place] = "other"
            docs.append((100 * n + place, " ".join(["before"] * 3 + w + ["after"] * 3)))
    found = overlaps(table(spark, docs), table(spark, items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.matched_words for r in found.collect()}
    assert got == {(d, d // 100): d // 100 - 1 for d, _ in docs}


def test_decontamination(spark):
    rng, vocab = random.Random(3), vocabulary(3)
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([40, 25, 13, 12, 9, 8, 3])]
    items += [(90, None), (None, "null items too " + " ".join(rng.choices(vocab, k=20)))]
    docs = []
    for i, (item, passage) in enumerate(itertools.product(items, range(9))):
        w = (passage % 3) * ["x"] + changed(rng, reference.words(item[1]), passage // 2)
        docs.append((i, " ".join(rng.choices(vocab, k=30) + w + rng.choices(vocab, k=5))))
    docs += [(None, items[0][1]), (1000, None), (1001, ""), (1002, items[1][1].upper())]
    got = {
        (r.doc_id, r.item_id): r.matched_words
        for r in overlaps(clashing(spark, docs), table(spark, items, "item_id long, text string")).collect()
    }
    assert got == reference.leaks(docs, items)
    kept = decontaminated(clashing(spark, docs), table(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert None not in {r.doc_id for r in kept.collect()}
    nothing = table(spark, [], "item_id long, text string")
    assert decontaminated(table(spark, docs), nothing).count() == len(docs)
    assert overlaps(table(spark, []), table(spark, items, "item_id long, text string")).count() == 0


def test_native_plans_hold_no_python(spark, small_dir):
    for name in ("op1_decontamination", "op3_mixing"):
        plan = queries.QUERIES[name](spark, small_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def mixed(spark, rows, **options):
    docs = table(spark, rows, "doc_id long, text string, source string, times string")
    return fair_mix(docs, **options)


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("a", 900), ("b", 300), ("c", 200), (None, 40), ("d", 1)):
        rows += [(len(rows) + i, "w " * rng.randint(0, 60), source, "") for i in range(n)]
    result = mixed(spark, rows)
    assert result.columns == ["doc_id", "text", "source", "size", "source_size", "target", "times"]
    got = result.collect()
    assert len(got) == len(rows) and {r.times for r in got} <= {0, 1, 2}
    total = sum(r.size for r in got)
    by_source = {r.source: r for r in got}
    assert sum(r.target for r in by_source.values()) == pytest.approx(1.5 * total)
    taken = {s: sum(r.times * r.size for r in got if r.source == s) for s in by_source}
    assert 1.5 * total - 60 <= sum(taken.values()) <= 1.5 * total
    for source, r in by_source.items():
        assert r.target <= 2 * r.source_size
        assert abs(taken[source] - r.target) <= 120
    # Weights 5, 2, 1, 5 and, for the NULL source, 2: open sources share by weight.
    open_ = {s: r.target for s, r in by_source.items() if r.target < 2 * r.source_size}
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    assert len({round(t / weight[s], 6) for s, t in open_.items()}) == 1
    assert sorted(map(repr, mixed(spark, rows).collect())) == sorted(map(repr, got))


def test_mixing_edge_rows(spark):
    rows = [(1, None, "a", ""), (None, "x y", "a", ""), (2, "x y z", None, ""), (2, "x y z", None, ""),
            (3, "", "b", "")]
    got = mixed(spark, rows).collect()
    assert len(got) == 5
    assert all(r.times <= 2 and (r.size == 0 or r.source_size > 0) for r in got)
    assert {r.target for r in got if r.source == "b"} == {0.0}
    assert mixed(spark, []).count() == 0
    assert {r.target for r in mixed(spark, [(1, None, "a", ""), (2, " ", None, "")]).collect()} == {0.0}


RULES = (("block", "bad.org", "/"), ("allow", "good.org", "/ok/"), ("block", "good.org", "/"))


def verdicts(spark, rows, links=None):
    pages = spark.createDataFrame(
        [(i, u, h, "x") for i, (u, h) in enumerate(rows)],
        "page_id long, url string, html string, verdict string",
    )
    known = spark.createDataFrame(links, "url string, target string") if links else None
    got = url_verdicts(pages, RULES, known)
    return [(r.rule, r.verdict) for r in got.orderBy("page_id").collect()]


def test_url_aliases_take_decisions(spark):
    canonical = '<link href="https://BAD.org/a" rel="canonical">'
    refresh = "<META http-equiv=refresh content='0; url=https://x.net/hop'>"
    rows = [
        ("http://x.net/one.html?u=1", canonical),
        ("https://x.net/one/#top", None),
        ("https://x.net/two", refresh),
        ("https://x.net/hop", None),
        ("https://x.net/free", "<link rel=canonical href=/relative>"),
        ("https://good.org/ok/1", None),
        ("https://sub.good.org/no", None),
        ("https://notgood.org/no", None),
        ("https://y.net/both", None),
        (None, None),
        ("no scheme", canonical),
        ("https://x.net/one.html", None),
    ]
    links = [("https://x.net/hop", "https://bad.org/b"), ("https://y.net/both", "https://bad.org/c"),
             ("https://y.net/both", "https://good.org/ok/2"), (None, "https://bad.org/"), ("https://z.net", None)]
    assert verdicts(spark, rows, links) == [
        (None, "block"),
        (None, "allow"),  # no page declares it an alias of the first
        (None, "block"),
        (None, "block"),
        (None, "allow"),
        ("good.org/ok/", "allow"),
        ("good.org/", "block"),
        (None, "allow"),
        (None, "allow"),  # an allow among the aliases overrides the block
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
    ]
    assert verdicts(spark, []) == []


def test_addresses_and_rules_that_tie(spark):
    page = '<link rel="canonical" href="HTTP://Bad.ORG/a">'
    rows = [("http://x.net", page), ("HTTP://X.net/#f", None), ("http://x.net/?q=1", None), ("https://x.net", None),
            ("http://x.net/index.html", None), ("http://x.net", None)]
    assert [v for _, v in verdicts(spark, rows)] == ["block", "block", "allow", "allow", "allow", "block"]
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for both in (("allow", "block"), ("block", "allow")):
        assert url_verdicts(pages, [(v, "a.net", "/") for v in both]).first().verdict == "allow"


def test_url_sql_with_declared_links(spark, tmp_path):
    """The registered query and its SQL on pages that declare links of every form."""
    hosts = [f"h{n}.org" for n in range(150)] + [f"N{n}.net" for n in range(20)] + ["d.example.com"]
    paths = ["", "/", "/en/1", "/es/2?x=1", "/fr/a/../b", "/p/q/./r.html#t", "/de/"]
    targets = ["/es/9", "../up", "//c.org/de/", "?y=2", "#top", "", "mailto:x@net", "https://n3.net/fr/z", "q/./r/..",
               "https://n4.net/es/3", "http://h7.org", "//n5.net/es/"]
    rng = random.Random(12)
    rows = []
    for i in range(400):
        url = rng.choice(["http", "https", "HTTPS"]) + "://" + rng.choice(hosts) + rng.choice(paths)
        tags = [rng.choice(["<link rel=canonical href='%s'>", '<META http-equiv="refresh" content="1; URL=%s">',
                            "<a href='%s'>", "<link href=%s rel='canonical'>"]) % rng.choice(targets)
                for _ in range(rng.choice([0, 0, 1, 3]))]
        if rng.random() < 0.2:
            tags.insert(0, f'<base href="{rng.choice(targets)}">')
        rows.append((i, rng.choice([url, url, url, url, None, "no scheme"]), " ".join(tags) or None))
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = queries.op8_url_filter(spark, str(tmp_path))
    assert difference(found, con, statements.URL_FILTER) is None
    by_alias = found.where("rule IS NULL AND verdict = 'block'").count()
    assert by_alias > 10


def test_url_links_of_every_tag_and_form(spark):
    def to(*targets):
        return "".join(f'<link rel="canonical" href="{t}">' for t in targets)

    def hop(*targets):
        return "".join(f'<meta http-equiv="refresh" content="0; url={t}">' for t in targets)

    blocked = [
        ("https://a.net/1", to("https://x.net/none", "https://bad.org/1")),  # the second tag
        ("https://a.net/2", hop("https://x.net/none2", "https://bad.org/2")),
        ("https://bad.org/x/3", to("/y/3?q#f")), ("https://a.net/3", hop("//bad.org/y/3")),
        ("https://b.net/d/e/4.html?u=/v/", to("../f/./4")), ("https://b.net/d/f/4", to("//bad.org/4")),
        ("https://c.net", hop("five")), ("https://c.net/five", hop("//bad.org/5")),
        ("https://d.net/a/6?x=1", to("?x=2") + hop("//bad.org/6")),
        ("https://e.net/7", '<base href="//bad.org/in/">' + to("7")),
        ("https://f.net/8", to("/go?to=https://x.net/none3", "/../9")), ("https://f.net/9", hop("//bad.org/9")),
    ]
    free = [
        ("https://g.net/1", to("mailto:a@bad.org", "javascript:void(0)", "#top", "", "g2")),
        ("https://g.net/g2", None),
        ("no scheme", to("/1")),
        (None, to("/1")),
        ("https://x.net/none3", None),
    ]
    got = verdicts(spark, blocked + free)
    assert [v for _, v in got[: len(blocked)]] == [
        "block" for _ in blocked
    ] and [v for _, v in got[len(blocked) :]] == ["allow" for _ in free]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 3000), rng.randint(0, 3000)) for _ in range(1500)]
    edges += [(i, i + 1) for i in range(5000, 5300)]  # a path
    edges += [(9000, i) for i in range(9001, 9400)] + [(7, 7), (None, 3), (4, None)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = reference.groups({i for e in real for i in e}, real)
    assert len(got) == len(want) and {r.id: r.component for r in got} == want
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).count() == 0


def test_hot_groups_stay_whole(spark):
    """A third of the rows in one group of near copies, another third exact copies."""
    rng, vocab = random.Random(6), vocabulary(6)
    near, copy = rng.choices(vocab, k=90), rng.choices(vocab, k=90)
    rows = [(i, " ".join(changed(rng, near, 1))) for i in range(150)]
    rows += [(1000 + i, " ".join(copy)) for i in range(150)]
    rows += [(2000 + i, " ".join(rng.choices(vocab, k=60))) for i in range(150)]
    got = near_duplicates(table(spark, rows)).groupBy("component_id").agg(F.count("*").alias("n"))
    sizes = {r.component_id: r.n for r in got.collect()}
    links = reference.near_links(rows, 5, 80)
    want = reference.groups([d for d, _ in rows], links)
    assert sizes == {c: sum(1 for x in want.values() if x == c) for c in set(want.values())}


def test_factors_copy_stretches_of_earlier_documents(spark, corpus):
    rows = [(d, t) for d, t in corpus if d is not None]
    by_id = {d: reference.words(t) for d, t in rows}
    expected = reference.cut_words(rows, 50)
    flags = {d: [False] * len(w) for d, w in by_id.items()}
    found = copied_factors(table(spark, rows)).collect()
    for f in found:
        assert f.ref_id < f.doc_id and f.words >= 50
        copy = by_id[f.doc_id][f.start : f.start + f.words]
        source = by_id[f.ref_id][f.ref_start : f.ref_start + f.words]
        assert copy == source and len(copy) == f.words
        flags[f.doc_id][f.start : f.start + f.words] = [True] * f.words
        # The factor ends where its reference stops to agree.
        after = (by_id[f.doc_id][f.start + f.words :][:1], by_id[f.ref_id][f.ref_start + f.words :][:1])
        others = [g for g in found if g.doc_id == f.doc_id and f.start < g.start <= f.start + f.words]
        assert after[0] != after[1] or not after[0] or others
    assert len(found) > 20
    assert flags == {d: gone for d, (_, gone) in expected.items()}


def test_ids_shared_by_different_texts_lose_no_link(spark):
    rng, vocab = random.Random(31), vocabulary(31)
    b, c, d = (rng.choices(vocab, k=120) for _ in range(3))
    near = lambda w: " ".join(changed(rng, w, 2))
    rows = [(3, " ".join(b)), (9, near(b)), (9, " ".join(c)), (12, near(c)), (20, " ".join(d))]
    found = near_duplicates(table(spark, rows), k=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [
        (3, 3, True), (9, 3, False), (9, 3, False), (12, 3, False), (20, 20, True),
    ]
    # Two classes that begin with the same id, linked with different documents.
    rows = [(3, " ".join(b)), (3, " ".join(c)), (7, near(b)), (8, near(c)), (-5, " ".join(d))]
    found = near_duplicates(table(spark, rows), k=2).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(3, 3), (7, 3), (8, 3), (-5, -5)}


def test_long_texts_and_large_benchmarks_take_the_same_way(spark, monkeypatch):
    rng, vocab = random.Random(32), vocabulary(32, 5000)
    passages = [rng.choices(vocab, k=rng.choice([9, 12, 20, 40])) for _ in range(30)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(0, " ".join(passages[0]))]
    long = rng.choices(vocab, k=100_000)
    long[50_000:50_000] = changed(rng, passages[5], 1)
    long[99_000:99_000] = passages[7]
    docs = [(1, " ".join(long)), (None, " ".join(passages[3])), (2, "short"), (2, None)]
    docs += [(10 + i, " ".join(rng.choices(vocab, k=30) + changed(rng, p, 1))) for i, p in enumerate(passages)]
    small = {(r.doc_id, r.item_id): r.matched_words for r in overlaps(
        table(spark, docs), table(spark, items, "item_id long, text string")).collect()}
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 0)
    by_shuffle = overlaps(table(spark, docs), table(spark, items, "item_id long, text string"))
    plan = by_shuffle._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.item_id): r.matched_words for r in by_shuffle.collect()} == small
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("doc_words" in line for line in exchanged)
    assert small[1, 5] == len(passages[5]) - 1 and small[1, 7] == len(passages[7])
    short = [(d, t) for d, t in docs if d != 1]
    assert {k: n for k, n in small.items() if k[0] != 1} == reference.leaks(short, items)
