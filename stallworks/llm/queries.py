"""One registered query per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stallworks.llm import statements
from stallworks.llm.collocations import collocations
from stallworks.llm.decontamination import overlaps
from stallworks.llm.embedding_dedup import embedding_duplicates
from stallworks.llm.language_id import identified
from stallworks.llm.mixing import fair_mix
from stallworks.llm.near_dedup import near_duplicates
from stallworks.llm.quality import quality_scores
from stallworks.llm.sampling import fold
from stallworks.llm.secret_scan import BASE_KINDS, secret_spans, written_out
from stallworks.llm.source_audit import source_divergence
from stallworks.llm.substring_dedup import removed_spans
from stallworks.llm.token_counts import model_path, token_counts
from stallworks.llm.toxicity import toxicity_scores
from stallworks.llm.url_filter import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    scored = toxicity_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mix(_read(spark, sf_dir, "documents"))
    taken = (F.col("times") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, model_path())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.where(fold(F.col("doc_id"), 4) != 2)
    found = identified(docs.select("doc_id", "text"), labelled)
    return found.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    scored = quality_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_verdicts(_read(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(_read(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, BASE_KINDS),
        F.sha2(written_out(base), 256).alias("base_sha256"),
        written_out(F.col("spans")).alias("spans"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_decontamination,
        op2_toxicity,
        op3_mixing,
        op4_token_counts,
        op5_near_duplicates,
        op6_language,
        op7_quality,
        op8_url_filter,
        op9_substrings,
        op10_embeddings,
        op11_source_divergence,
        op12_secrets,
        op13_collocations,
    )
}


def queries() -> dict[str, Query]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(statements.STATEMENTS)
