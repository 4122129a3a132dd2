"""From raw documents to a training mix in stages; each is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallworks.llm.decontamination import decontaminated
from stallworks.llm.mixing import fair_mix
from stallworks.llm.near_dedup import deduplicated
from stallworks.llm.sampling import fold
from stallworks.llm.substring_dedup import without_repeats
from stallworks.llm.toxicity import toxicity_scores
from stallworks.operators.ranking import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Columns the toxicity stage makes; the caller's of that name are set aside meanwhile.
_SCORED = ("score", "predicted")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; learned as in its query.

    NULL and empty texts are scored like any other, equal rows alike, and all columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    aside = {c: f"__own_{c}" for c in _SCORED if c in docs.columns}
    scored = toxicity_scores(docs.withColumnsRenamed(aside), labels, keep_text=True)
    kept = scored.where("predicted = 0").drop(*_SCORED)
    return kept.withColumnsRenamed({new: c for c, new in aside.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at 0.8 similarity or more.

    Texts without words are in no group and stay, as do rows without an id; rows that repeat an id
    with the same text are one document and stay or go together.
    """
    return deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that an earlier document has in the same 50-word window.

    No row goes, and NULL texts stay NULL; ``n_chars``, where it is there, follows the text.
    """
    cut = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; rows without an id or a text are judged too."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``times`` each is taken.

    Adds ``size``, ``source_size``, ``target`` and ``times``; a caller's columns of these names
    are replaced, as this stage is the last.
    """
    return fair_mix(docs).where("times > 0")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring deduplication", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
]

# The toxicity stage learns a model, which SQL cannot express; tests compare the stages
# with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
