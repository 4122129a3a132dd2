"""Bounded samples for fitting, and the folds of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.operators.ranking import written

_SCALE = 1 << 30
_LONGEST_SHARE = 64


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def bounded_sample(rows: DataFrame, key: str, about: int) -> DataFrame:
    """About ``about`` rows at most, the same ones each time, spread by a hash of the key.

    Rows with a NULL key are left out. Choosing by hash needs no sort and no transfer of rows.
    """
    rows = rows.where(F.col(key).isNotNull())
    total = rows.count()
    if total <= about:
        return rows
    share = int(_SCALE * about / total)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_SCALE)) < share)


def labelled_sample(
    texts: DataFrame, labels: DataFrame, value: str, about: int, about_bytes: int | None = None
) -> DataFrame:
    """``(doc_id, text, value)`` of a bounded sample of the labelled rows, equal rows once.

    Labels are sampled before texts are joined; each id has one row per label by then, so the
    sample is small by its bound and texts are filtered where they are read. Ids that many
    texts share are sampled again by id and text. With ``about_bytes`` texts longer than a
    64th of it are left out, and of the others about so many bytes are taken at most.
    """
    known = labels.where(F.col(value).isNotNull()).select("doc_id", value).distinct()
    picked = bounded_sample(known, "doc_id", about)
    rows = texts.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    if about_bytes is not None:
        rows = rows.where(size <= about_bytes // _LONGEST_SHARE)
    rows = written(rows.distinct())
    n, n_bytes = rows.agg(F.count("*"), F.sum(size.cast("long"))).first()
    share = min(1.0, about / max(n, 1), (about_bytes or n_bytes or 1) / max(n_bytes or 0, 1))
    if share >= 1:
        return rows
    place = F.pmod(F.xxhash64(F.lit("row"), "doc_id", "text"), F.lit(_SCALE))
    return rows.where(place < int(_SCALE * share))
