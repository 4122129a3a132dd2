"""Raw CSV files in, cleaned tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallworks.operators.checks import stacked
from stallworks.operators.cleaning import CLEANERS, FILE_ORDER
from stallworks.sources.formats import CSV, format_options
from stallworks.sources.quoted_records import read_quoted_csv
from stallworks.sources.schemas import TABLE_NAMES, text_schema

# Every business file is "<source>_<table>_dataset.csv" in the public data
# set, except the category translation.
FILE_PATTERNS = {name: f"*_{name}_dataset.csv" for name in TABLE_NAMES} | {
    "category_name": "product_category_name_translation.csv"
}

# What pandas reads as a missing value by default.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def known(column: str) -> Column:
    return F.when(~F.col(column).isin(*MISSING_WORDS), F.col(column)).alias(column)


def read_raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One raw table, every column as text.

    Reviews hold free text with quotes and line breaks. Their files are split all the same,
    and their rows also carry the place in the file, which decides which repeated review is
    the first.
    """
    path = f"{folder}/{FILE_PATTERNS[name]}"
    if name != "order_reviews":
        raw = (
            spark.read.schema(text_schema(name))
            .options(**CSV)
            .option("enforceSchema", False)
            .csv(path)
        )
        return raw.select(*[known(c) for c in raw.columns])
    raw = read_quoted_csv(spark, path, text_schema(name), CSV["quote"], CSV["escape"])
    place = zip(("file", "block", "row"), FILE_ORDER)
    return raw.select(
        *[known(c) for c in text_schema(name).names], *[F.col(c).alias(new) for c, new in place]
    )


def clean_all(
    spark: SparkSession, raw_folder: str, clean_folder: str, fmt: str = "parquet"
) -> DataFrame:
    """Clean and write the eight tables; report the rows and columns of each."""
    reports = []
    for name in TABLE_NAMES:
        path = f"{clean_folder}/{name}"
        table = CLEANERS[name](read_raw(spark, raw_folder, name))
        table.write.mode("overwrite").format(fmt).options(**format_options(fmt, name)).save(path)
        stored = (
            spark.read.format(fmt).schema(table.schema).options(**format_options(fmt, name)).load(path)
        )
        reports.append(
            stored.agg(F.count("*").alias("rows_cnt")).select(
                F.lit(name).alias("tbl"),
                "rows_cnt",
                F.lit(len(table.columns)).alias("columns_cnt"),
            )
        )
    return stacked(reports)
