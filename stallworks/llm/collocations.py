"""Phrase collocations: phrases of up to four words that hold together, per language.

Candidates come level by level, safely after Apriori: a phrase of k words can only be frequent
if its first and its last k - 1 words are. Every level reads the documents, drops
positions whose two shorter phrases are missing in a bitmap of bounded size, and adds up the rest by
64-bit hashes, of the last word by 32 bits. Bitmap and hashes may let a rare phrase through but never lose a frequent
one, so candidates are a superset of the frequent phrases; as hashes of a shorter phrase and a
word they are joined back to words.

The published counts come from a recount of the candidates. The documents are read once for it, and
every word position leaves its window: the words from there on as long as a bitmap of all beginnings
of candidates lets them through. Windows are compared by words, equal ones are added up, and no
candidate is longer than the window it begins. Shards of the candidates become double-array tries over
bytes, which are broadcast; at all windows of a block at once, states advance level by level, one more
word each, and the accepting states are counted as often as the window occurs; sums over tasks
and shards are exact. One broadcast holds ``ROUND_BYTES`` of built tries at most, or one larger trie;
more candidates take more rounds, each of which reads the windows that begin with its first words.

Cuts, containment and the order of results are joins and windows over the counted phrases.

Defined cases: a NULL text is empty, a NULL lang is ``und`` and joins rows that say so; an empty table
has no rows; repeated rows count again; further columns are ignored. Words are cut by spaces and tabs,
pieces by ``.,;:!?`` and line ends; no phrase spans two pieces or two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallworks.llm.double_array import ROOT, DoubleArray, double_array
from stallworks.llm.terms import encoded, runs, utf8
from stallworks.llm.text import mix, signed, span_hashes, text_blocks
from stallworks.operators.ranking import written

MIN_COUNT = 30
MOST_WORDS = 4
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
NO_LANG = "und"

# Bitmaps have 8 MB as a broadcast, or 16 MB where that is less than so many bits for each phrase.
BITMAP_BITS = 1 << 26
_MOST_BITS = 1 << 27
_BITS_EACH = 16
# The last word of a phrase is counted by so many bits of its hash; more words than one may fit.
_LAST_BITS = 32
SHARD_BYTES = 16 << 20
ROUND_BYTES = 48 << 20
# For the number of shards: a trie takes at most about so many bytes for each byte of its phrases.
_TRIE_FACTOR = 16
_CHUNK_BITS = 1 << 15  # of Spark's bitmap functions
# Texts are worked on in blocks of so many bytes, and leave in batches of so many rows.
_BLOCK_BYTES = 4 << 20
_ROWS = 1 << 16
# Cells of (lang, word) are marked in an array, without a sort, up to so many for each position.
_DENSE = 4

_U64 = np.uint64
# What ends a piece, and what parts words.
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_PARTS = b" \x09"
_IS_CUT = np.zeros(256, dtype=bool)
_IS_CUT[[*_CUTS]] = True
_IS_BREAK = _IS_CUT.copy()
_IS_BREAK[[*_PARTS]] = True
_AFTER_LANG = b"\xff"  # in no UTF-8 text

_SPACE = ord(" ")


class Positions:
    """The words of a block: codes, distinct words, languages, and which word has a next one.

    Where the texts are windows, phrases are counted from ``heads`` only, the first word of each, as
    often as ``times`` says; elsewhere from every word, and both are None.
    """

    def __init__(
        self,
        data: np.ndarray,
        offsets: np.ndarray,
        row_lang: np.ndarray,
        times: np.ndarray | None = None,
    ):
        found, starts, rows = runs(data, offsets, _IS_BREAK)
        self.codes, self.words = encoded(found)
        self.lang = row_lang[rows]
        cuts = np.cumsum(_IS_CUT[data], dtype=np.int32)[starts]
        self.joined = np.zeros(len(starts), dtype=bool)
        if len(starts):
            self.joined[:-1] = (rows[1:] == rows[:-1]) & (cuts[1:] == cuts[:-1])
        self.heads = self.times = None
        if times is not None:
            self.heads = np.flatnonzero(np.diff(rows, prepend=-1))
            self.times = times[rows[self.heads]]

    def hashes(self, lang_hashes: np.ndarray) -> np.ndarray:
        """Of (lang, word) at every position."""
        words = span_hashes(*utf8(self.words))
        return word_hashes(lang_hashes[self.lang], words[self.codes])


def word_hashes(lang_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(lang_hashes * _U64(0xD1342543DE82EF95) + hashes)


def longer_hashes(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that one word follows; the hash of a word is that of its phrase of one."""
    return mix(phrases * _U64(0x9FB21C651E98DF25) ^ words)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return span_hashes(*utf8(langs))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Positions]]:
    """Blocks of texts or, where rows have ``times``, of windows."""
    for batch in batches:
        row_lang, langs = encoded(batch.column("lang"))
        windows = "times" in batch.schema.names
        times = batch.column("times").to_numpy(zero_copy_only=False) if windows else None
        for row, data, offsets in text_blocks(batch.column("text"), _BLOCK_BYTES):
            rows = slice(row, row + len(offsets) - 1)
            yield langs, Positions(data, offsets, row_lang[rows], times[rows] if windows else None)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for row in range(0, batch.num_rows, _ROWS):
        yield batch.slice(row, _ROWS)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, at in _blocks(batches):
        cells, n = np.unique(at.lang * len(at.words) + at.codes, return_counts=True)
        if not len(cells):
            continue
        lang, code = np.divmod(cells, len(at.words))
        yield from _sliced(
            pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang)), at.words.take(pa.array(code)), pa.array(n, pa.int64())],
                ["lang", "phrase", "n"],
            )
        )


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of single words, as ``Positions.hashes`` has them."""
    for batch in batches:
        lang = _lang_hashes(batch.column("lang"))
        words = span_hashes(*utf8(batch.column("phrase")))
        yield batch.append_column("hash", pa.array(signed(word_hashes(lang, words))))


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & _U64(len(bitmap) * 8 - 1)
    return (bitmap[(bit >> _U64(3)).astype(np.int64)] >> (bit & _U64(7)).astype(np.uint8)) & 1 == 1


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct hash is, and how often it occurs."""
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    starts = np.flatnonzero(new)
    return order[starts], np.diff(starts, append=len(hashes))


def _pair_counts(bitmap: Broadcast, k: int):
    """Occurrences of (phrase of k - 1 words, next word) by hash, where Apriori leaves a chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for langs, at in _blocks(batches):
            words = at.hashes(_lang_hashes(langs))
            shorter, whole = words, np.ones(len(words), dtype=bool)
            for more in range(1, k - 1):
                whole = whole[: len(words) - more] & at.joined[more - 1 : len(words) - 1]
                shorter = longer_hashes(shorter[: len(words) - more], words[more:])
            known = whole & _known(bits, shorter)
            place = np.flatnonzero(known[:-1] & known[1:] & at.joined[: max(len(known) - 1, 0)])
            if not len(place):
                continue
            prefix, last = shorter[place], words[place + k - 1]
            both = longer_hashes(prefix, last)
            first, n = _counted(both)
            yield from _sliced(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(prefix[first])),
                        pa.array(signed(last[first] & _U64((1 << _LAST_BITS) - 1))),
                        pa.array(n, pa.int64()),
                    ],
                    ["prefix", "last", "n"],
                )
            )

    return run


def _with_longer_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix, last = [
            batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("prefix", "word_hash")
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("phrase"), pa.array(signed(longer_hashes(prefix, last)))],
            ["lang", "phrase", "hash"],
        )


def _bits(n: int) -> int:
    """Bits of a bitmap of so many phrases; the largest one is crowded, and lets more through."""
    return min(max(1 << (n * _BITS_EACH).bit_length(), BITMAP_BITS), _MOST_BITS)


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash, set on the executors; the driver puts chunks of 4 KB together.

    Hashes are dealt by chunk first, so that no task makes more of the bitmap than its share.
    """
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    chunks = (
        phrases.select(F.shiftright(bit, 15).alias("chunk"), bit.bitwiseAND(F.lit(_CHUNK_BITS - 1)).alias("bit"))
        .repartition("chunk")
        .groupBy("chunk")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for chunk, part in chunks:
        out[chunk * (_CHUNK_BITS // 8) :][: len(part)] = np.frombuffer(part, dtype=np.uint8)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )


def candidates(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)`` of all words, and ``(lang, phrase, words)`` of all phrases to be recounted."""
    spark = docs.sparkSession
    counted = written(
        _texts(docs)
        .mapInArrow(_word_counts, "lang string, phrase string, n long")
        .groupBy("lang", "phrase")
        .agg(F.sum("n").alias("n"))
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    singles = written(
        counted.where(F.col("n") >= min_count)
        .select("lang", "phrase")
        .mapInArrow(_with_hash, "lang string, phrase string, hash long")
    )
    levels, shorter = [singles.withColumn("words", F.lit(1))], singles
    last = singles.select(
        F.col("lang").alias("__lang"),
        F.col("phrase").alias("word"),
        F.col("hash").alias("word_hash"),
        F.col("hash").bitwiseAND(F.lit((1 << _LAST_BITS) - 1)).alias("last"),
    )
    for k in range(2, MOST_WORDS + 1):
        sent = spark.sparkContext.broadcast(_bitmap(shorter, _bits(shorter.count())))
        often = written(
            _texts(docs)
            .mapInArrow(_pair_counts(sent, k), "prefix long, last long, n long")
            .groupBy("prefix", "last")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count)
            .drop("n")
        )
        sent.destroy()
        prefixes = shorter.withColumnRenamed("hash", "prefix")
        shorter = written(
            often.join(prefixes, "prefix")
            .join(last, "last")
            .where("lang = __lang")
            .select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "prefix", "word_hash")
            .mapInArrow(_with_longer_hash, "lang string, phrase string, hash long")
        )
        levels.append(shorter.withColumn("words", F.lit(k)))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionAll(level)
    return totals, found.drop("hash")


def _key(lang: str, phrase: str) -> bytes:
    return lang.encode() + _AFTER_LANG + phrase.encode()


def _trie(group: pa.Table) -> pa.Table:
    rows = zip(*[group.column(c).to_pylist() for c in ("lang", "phrase", "words")])
    rows = sorted(rows, key=lambda r: _key(*r[:2]))
    made = double_array([_key(lang, phrase) for lang, phrase, _ in rows])
    shard = group.column("shard").slice(0, 1)
    arrays = [pa.array([x.tobytes()], pa.binary()) for x in (made.base, made.check, made.accept)]
    names = [[[r[i] for r in rows]] for i in (0, 1)]
    words = [[r[2] for r in rows]]
    return pa.table(
        [
            shard,
            *arrays,
            *[pa.array(x, pa.list_(pa.string())) for x in names],
            pa.array(words, pa.list_(pa.int32())),
        ],
        ["shard", "base", "check", "accept", "langs", "phrases", "words"],
    )


_TRIE = (
    "shard long, base binary, check binary, accept binary, langs array<string>,"
    " phrases array<string>, words array<int>"
)


def _first_words(at: Positions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages and codes of the distinct (lang, word), and which of these is at every position."""
    cell = at.lang * len(at.words) + at.codes
    most = int(cell.max(initial=-1)) + 1
    if most <= _DENSE * len(cell):
        met = np.zeros(most, dtype=bool)
        met[cell] = True
        cells, inverse = np.flatnonzero(met), (np.cumsum(met) - 1)[cell]
    else:
        cells, inverse = np.unique(cell, return_inverse=True)
    lang, code = np.divmod(cells, max(len(at.words), 1))
    return lang, code, inverse


def _accepted(
    trie: DoubleArray,
    langs: pa.Array,
    at: Positions,
    first_words: tuple[np.ndarray, np.ndarray, np.ndarray],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and times of the phrases accepted from all heads, one level of words after the other."""
    data, starts, lengths = utf8(at.words)
    lang_data, lang_starts, lang_lengths = utf8(langs)
    states = trie.walk(np.full(len(langs), ROOT), lang_data, lang_starts, lang_lengths)
    met = np.flatnonzero(states >= 0)
    states[met] = trie.step(states[met], _AFTER_LANG[0])
    lang, code, inverse = first_words
    cells = inverse if at.heads is None else inverse[at.heads]
    after = trie.walk(states[lang], data, starts[code], lengths[code])[cells]
    met = np.flatnonzero(after >= 0)
    place, after = met if at.heads is None else at.heads[met], after[met]
    times = np.ones(len(met), dtype=np.int64) if at.times is None else at.times[met]
    for _ in range(MOST_WORDS):
        numbers = trie.accept[after]
        yield numbers[numbers >= 0], times[numbers >= 0]
        more = at.joined[place]
        place, after, times = place[more] + 1, trie.step(after[more], _SPACE), times[more]
        place, after, times = place[after >= 0], after[after >= 0], times[after >= 0]
        code = at.codes[place]
        after = trie.walk(after, data, starts[code], lengths[code])
        place, after, times = place[after >= 0], after[after >= 0], times[after >= 0]


def _recounted(tries: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[tuple[int, int, DoubleArray]] = tries.value
        sums = [np.zeros(n, dtype=np.int64) for _, n, _ in shards]
        for langs, at in _blocks(batches):
            if not len(at.codes):
                continue
            # The first word is walked once for each distinct (lang, word), found once for all tries.
            first_words = _first_words(at)
            for (_, _, trie), total in zip(shards, sums):
                for numbers, times in _accepted(trie, langs, at, first_words):
                    np.add.at(total, numbers, times)
        for (shard, _, _), total in zip(shards, sums):
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(met), shard)), pa.array(met), pa.array(total[met])],
                ["shard", "at", "f"],
            )

    return run


def _begin_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the first word, the first two words and so on of given windows."""
    for langs, at in _blocks(batches):
        words = at.hashes(_lang_hashes(langs))
        place, begins = at.heads, words[at.heads]
        for k in range(1, MOST_WORDS + 1):
            yield pa.RecordBatch.from_arrays([pa.array(signed(begins))], ["hash"])
            more = at.joined[place + k - 1]
            place = place[more]
            begins = longer_hashes(begins[more], words[place + k])


def _windows(bitmap: Broadcast):
    """Windows of all word positions as ``(lang, text, times)``, equal ones of a block in one row.

    A window grows as long as the bitmap has its words so far. Windows of k words are numbered by
    the number of their first k - 1 words and the last one, so equal numbers are equal words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for langs, at in _blocks(batches):
            words = at.hashes(_lang_hashes(langs))
            place = np.flatnonzero(_known(bits, words))
            begins, number = words[place], _first_words(at)[2][place]
            for k in range(1, MOST_WORDS + 1):
                if not len(place):
                    break
                going = np.flatnonzero(at.joined[place + k - 1]) if k < MOST_WORDS else place[:0]
                longer = longer_hashes(begins[going], words[place[going] + k])
                known = _known(bits, longer)
                going, begins = going[known], longer[known]
                ends = np.ones(len(place), dtype=bool)
                ends[going] = False
                n = np.bincount(number[ends])
                one = np.zeros(len(n), dtype=np.int64)
                one[number[ends]] = place[ends]
                met = np.flatnonzero(n)
                one = one[met]
                texts = [at.words.take(pa.array(at.codes[one + i])) for i in range(k)]
                text = pc.binary_join_element_wise(*texts, " ") if k > 1 else texts[0]
                yield from _sliced(
                    pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(at.lang[one])), text, pa.array(n[met], pa.int64())],
                        ["lang", "text", "times"],
                    )
                )
                place = place[going]
                number = number[going] * len(at.words) + at.codes[place + k]
                number = np.unique(number, return_inverse=True)[1]

    return run


def _rounds(sizes: list[tuple[int, int]], round_bytes: int) -> list[list[int]]:
    """Shards, given with their bytes, in rounds of so many bytes at most, or of one larger shard."""
    out, held = [], 0
    for shard, size in sizes:
        if not out or held + size > round_bytes:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += size
    return out


def phrase_counts(
    docs: DataFrame,
    phrases: DataFrame,
    shard_bytes: int = SHARD_BYTES,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``(lang, phrase, words, f)``: exact occurrences of given phrases of one to four words."""
    spark = docs.sparkSession
    n, size = phrases.agg(F.count("*"), F.sum(F.octet_length("phrase") + F.octet_length("lang") + 1)).first()
    shards = max(1, -(-(size or 0) * _TRIE_FACTOR // shard_bytes))

    def shard(phrase: str) -> Column:
        # All phrases that begin with the same word are walked in one trie.
        return F.pmod(F.xxhash64("lang", F.substring_index(phrase, " ", 1)), F.lit(shards))

    begins = phrases.select("lang", F.col("phrase").alias("text"), F.lit(1).alias("times"))
    sent = spark.sparkContext.broadcast(_bitmap(begins.mapInArrow(_begin_hashes, "hash long"), _bits(n)))
    windows = written(
        _texts(docs)
        .mapInArrow(_windows(sent), "lang string, text string, times long")
        .groupBy("lang", "text")
        .agg(F.sum("times").alias("times"))
        .withColumn("shard", shard("text"))
        .sortWithinPartitions("shard")  # so that a round reads little more than its own pages
    )
    sent.destroy()
    built = written(
        phrases.withColumn("shard", shard("phrase")).groupBy("shard").applyInArrow(_trie, _TRIE)
    )
    arrays = built.select("shard", "base", "check", "accept", F.size("phrases").alias("n"))
    made = arrays.select("shard", sum(F.octet_length(c) for c in ("base", "check", "accept")))
    found = None
    for members in _rounds(sorted(map(tuple, made.collect())), round_bytes) or [[-1]]:
        these = F.col("shard").between(members[0], members[-1])
        loaded = [
            (row["shard"], row["n"], DoubleArray(*[np.frombuffer(row[c], np.int32) for c in ("base", "check", "accept")]))
            for row in arrays.where(these).collect()
        ]
        sent = spark.sparkContext.broadcast(loaded)
        del loaded
        sums = (
            windows.where(these)
            .drop("shard")
            .mapInArrow(_recounted(sent), "shard long, at long, f long")
            .groupBy("shard", "at")
            .agg(F.sum("f").alias("f"))
        )
        sums = written(sums)
        sent.destroy()
        found = sums if found is None else found.unionAll(sums)
    names = built.select("shard", F.posexplode(F.arrays_zip("langs", "phrases", "words")).alias("at", "x"))
    return names.join(found, ["shard", "at"]).select(
        F.col("x.langs").alias("lang"), F.col("x.phrases").alias("phrase"), F.col("x.words").alias("words"), "f"
    )


def _words_of(phrase: Column | str, first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, length), " ")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of every language."""
    totals, wanted = candidates(docs, min_count)
    counted = written(
        phrase_counts(docs, wanted, shard_bytes, round_bytes).where(F.col("f") >= min_count)
    )
    phrases = counted.where("words > 1").withColumnRenamed("f", "a")
    part = lambda name, f: counted.select(
        "lang", F.col("phrase").alias(name), F.col("f").alias(f)
    )
    cut = (
        phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
        .withColumn("head", _words_of("phrase", F.lit(1), F.col("k")))
        .withColumn("tail", _words_of("phrase", F.col("k") + 1, F.col("words") - F.col("k")))
        .join(part("head", "l"), ["lang", "head"])
        .join(part("tail", "r"), ["lang", "tail"])
    )
    # Through 38 digits, as the product may pass 64 bits.
    score = F.expr(f"cast((cast(a as decimal(20, 0)) * {SCALE}) div (l + r) as bigint)")
    scored = (
        cut.withColumn("score", score)
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    inside = (
        phrases.where("words > 2")
        .withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
        .withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
        .select("lang", _words_of("phrase", F.col("at"), F.col("size")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * COVERED_PERCENT)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
