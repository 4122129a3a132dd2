"""Records of CSV files whose quoted values hold line breaks, read in byte ranges.

A file is read as lines, so Spark splits it by bytes. Whether a line begins a record depends on
the number of quotes before it in the file: even outside a quoted value (doubled quotes count
twice), odd inside. Quotes are counted within each range; the counts of all ranges of a file, one
row per range, are summed up to the parity each range begins with. A line inside a quoted
value belongs to the last record begun before it, which may be in an earlier range.

Defined cases: a line ends with a line feed, and a carriage return before it is dropped, inside
values too; empty lines between records are skipped; quotes stand around whole values or, doubled,
inside them; a quoted value that is never closed takes the rest of its file; a byte order mark
at the start is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = ("file", "block", "chunk")
# A chunk holds at most two to this power lines; windows go over chunks, so that they stay small
# and spread over tasks however long the ranges are.
_CHUNK_BITS = 14


def _numbered_lines(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """``(file, block, chunk, row, line, quotes, inside)``: place, quotes, and quotes before in the chunk.

    A chunk is a stretch of lines of one byte range; a window holds one chunk.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_at"),
            F.regexp_replace("value", r"\r\z", "").alias("line"),
        )
        .withColumn("chunk", F.shiftright("_at", _CHUNK_BITS))
        .withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit(""))))
    )
    in_order = Window.partitionBy(*_RANGE).orderBy("_at")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(
        *_RANGE,
        F.row_number().over(in_order).alias("row"),
        "line",
        "quotes",
        F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("inside"),
    )


def _number(row: str):
    """Number of a line in its range from its row in the chunk: 1 first, in order, gaps allowed."""
    return F.shiftleft(F.col("chunk") - F.col("first_chunk"), _CHUNK_BITS) + F.col(row)


def _chunk_starts(lines: DataFrame) -> DataFrame:
    """Per chunk the quotes before it in its file, the last record begun before it, and its range's first."""
    even = F.col("inside") % 2 == 0
    chunks = lines.groupBy(*_RANGE).agg(
        F.sum("quotes").alias("quotes"),
        F.max(F.when(even, F.col("row"))).alias("last_even"),
        F.max(F.when(~even, F.col("row"))).alias("last_odd"),
    )
    earlier = (
        Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = chunks.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0))).withColumn(
        "first_chunk", F.min("chunk").over(Window.partitionBy("file", "block"))
    )
    counted = counted.withColumn(
        "last", F.when(F.col("before") % 2 == 0, F.col("last_even")).otherwise(F.col("last_odd"))
    )
    begun = F.when(F.col("last").isNotNull(), F.struct("block", _number("last").alias("row")))
    return counted.withColumn("begun", begun).select(
        *[F.col(c).alias(f"_{c}") for c in _RANGE],
        "before",
        "first_chunk",
        F.last("begun", ignorenulls=True).over(earlier).alias("open"),
    )


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, block, row, record)``: every record whole, with the place of its first line.

    Ordered by ``(file, block, row)`` the records are in file order.
    """
    lines = _numbered_lines(spark, path, quote)
    same = [F.col(c) == F.col(f"_{c}") for c in _RANGE]
    placed = lines.join(_chunk_starts(lines), same).withColumn("number", _number("row"))
    begins = (F.col("before") + F.col("inside")) % 2 == 0
    so_far = Window.partitionBy(*_RANGE).orderBy("row")
    own = F.last(F.when(begins, F.struct("block", F.col("number").alias("row"))), ignorenulls=True).over(so_far)
    of_record = placed.withColumn("start", F.coalesce(own, "open"))
    # A record of one line, as most are, is carried along; longer ones are put together in order.
    whole = of_record.groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "line"))).alias("parts")
    )
    return whole.select(
        "file",
        F.col("start.block").alias("block"),
        F.col("start.row").alias("row"),
        F.array_join("parts.line", "\n").alias("record"),
    ).where("record <> ''")


def read_quoted_csv(
    spark: SparkSession, path: str, schema: T.StructType, quote: str, escape: str
) -> DataFrame:
    """Columns of ``schema`` and ``(file, block, row)``; every file has a header.

    A file whose header names other columns is refused.
    """
    options = {"quote": quote, "escape": escape}
    parsed = quoted_records(spark, path, quote).withColumn(
        "value", F.from_csv("record", schema.simpleString()[len("struct<") : -1].replace(":", " "), options)
    )
    names = [f.name for f in schema.fields]
    as_named = F.lit(True)
    for name in names:
        as_named = as_named & F.coalesce(F.lower(F.trim(f"value.{name}")) == name.lower(), F.lit(False))
    refused = F.raise_error(
        F.concat(F.lit(f"header is not {','.join(names)} in "), F.col("file"))
    ).cast("boolean")
    is_header = (F.col("block") == 0) & (F.col("row") == 1)
    data = F.when(~is_header, F.lit(True)).when(as_named, F.lit(False)).otherwise(refused)
    return parsed.where(data).select(*[f"value.{n}" for n in names], "file", "block", "row")
