"""Review files with line breaks inside values, split by bytes, against the unsplit reader."""

from __future__ import annotations

import csv
import random

import pytest

from stallworks.sources.quoted_records import read_quoted_csv
from stallworks.sources.raw_csv import read_raw
from stallworks.sources.schemas import text_schema

HEADER = text_schema("order_reviews").names
PARTS = ["plain", 'a "quoted" word', "two\nlines", "\n", '"', "x,y", "", "ação", '\n"\n,"', "end\n"]


@pytest.fixture
def in_ranges(spark):
    """Files are cut every so many bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def cut(n: int):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield cut
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\n", **options)
        writer.writerow(HEADER)
        writer.writerows(rows)


def random_rows(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    return [
        [f"r{i}", f"o{i % 7}", str(i % 5), *["".join(rng.choices(PARTS, k=rng.randint(0, 4))) for _ in range(2)],
         "2018-01-01 00:00:00", f"t{i}"]
        for i in range(n)
    ]


def in_file_order(spark, path):
    found = read_quoted_csv(spark, str(path), text_schema("order_reviews"), '"', '"')
    rows = found.orderBy("file", "block", "row").collect()
    return [[v or "" for v in r[: len(HEADER)]] for r in rows]


@pytest.mark.parametrize("size", [17, 200, 5000])
def test_any_split_gives_all_records_in_order(spark, in_ranges, tmp_path, size):
    rows = random_rows(size, 250 if size > 100 else 40)
    write(tmp_path / "a.csv", rows, quoting=csv.QUOTE_ALL)
    write(tmp_path / "b.csv", rows[::-1])
    in_ranges(size)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    assert in_file_order(spark, tmp_path) == rows + rows[::-1]


def test_equals_the_unsplit_reader(spark, in_ranges, tmp_path):
    rows = random_rows(3, 120)
    write(tmp_path / "x_order_reviews_dataset.csv", rows)
    in_ranges(300)
    whole = spark.read.schema(text_schema("order_reviews")).csv(
        str(tmp_path), header=True, quote='"', escape='"', multiLine=True
    )
    expected = [[v or "" for v in r] for r in whole.collect()]
    assert in_file_order(spark, tmp_path) == expected == rows
    raw = read_raw(spark, str(tmp_path), "order_reviews")
    assert raw.columns == [*HEADER, "_file", "_block", "_row"] and raw.count() == 120
    assert len({r._block for r in raw.select("_block").collect()}) > 3


def test_one_record_over_many_ranges_and_odd_ends(spark, in_ranges, tmp_path):
    long = "line\n" * 300
    rows = [["r1", "o", "1", long, "", "", ""], ["r2", "o", "1", "", "", "", "last"]]
    write(tmp_path / "a.csv", rows)
    text = (tmp_path / "a.csv").read_text()
    # A byte order mark, carriage returns, an empty line and no line break at the end.
    odd = "﻿" + text.replace("\n", "\r\n").replace("\r\nr2", "\r\n\r\nr2").rstrip("\r\n")
    (tmp_path / "a.csv").write_text(odd, encoding="utf-8", newline="")
    in_ranges(100)
    assert in_file_order(spark, tmp_path) == rows


def test_empty_files_and_other_headers(spark, tmp_path):
    write(tmp_path / "a.csv", [])
    (tmp_path / "b.csv").write_text("")
    assert in_file_order(spark, tmp_path) == []
    (tmp_path / "c.csv").write_text("review_id,score\nr1,2\n")
    with pytest.raises(Exception, match="header is not"):
        in_file_order(spark, tmp_path)
