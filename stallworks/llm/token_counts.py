"""Exact token counts of every prefix of a text, for a public sentencepiece BPE model.

The last token of every prefix determines its encoding: a prefix of an encoding is the encoding
of its text, and a row of tokens is an encoding if merging never crosses from any token to the
next. So the dynamic program goes from left to right and finds for each prefix the one piece that
ends it and may follow the last token of the prefix before it; its count is one more. Whether
one piece may follow another is decided by merging the two alone, and remembered. Characters the
model has no piece for are their UTF-8 bytes and never merge.

The model writes a space as a mark and no piece holds a mark behind another character, so
no merge ever crosses the place where a run of marks begins. A text therefore falls into
chunks (marks and the characters up to the next mark) whose tables are independent; the table of
a text is made of theirs, and the total of a chunk met again is not computed again. Both claims are
checked when a model is loaded, the first by the library's counts of a probe; a model that breaks
them is refused. Tables answer questions about truncation and budgets without any encoding.

What a task remembers (totals of chunks, beginnings of tables, pairs) is bounded by number and
characters. The model file is found by path on the executors.

Defined cases: a NULL text is empty; an empty text has no tokens; a prefix is measured in
characters and may end anywhere; repeated rows are counted each; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
LIMIT = 4096

_MARK = "▁"
_REMEMBERED = 400_000
_REMEMBERED_CHARACTERS = 8_000_000
_REMEMBERED_PAIRS = 300_000
_REMEMBERED_HEADS = 100_000
_HEAD = 6
_LONG_CHUNK = 1_000
_PROBE = "A probe:  tokens, ünïcode 中文 \x00\t\r\n▁marks▁▁▁ <s> 12345 aaaaaaaaab ﬁ Å \U0001f600 "


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Token counts of all prefixes of texts for one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        self._scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.vocab_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))
        }
        if any(_MARK in p.lstrip(_MARK) for p in self._scores):
            raise ValueError("pieces of this model cross word boundaries")
        # Lengths of the pieces by their last two characters.
        self._tails: dict[str, list[int]] = {}
        for n, tail in sorted({(len(p), p[-2:]) for p in self._scores if len(p) > 1}, reverse=True):
            self._tails.setdefault(tail, []).append(n)
        self._split: dict[str, tuple[str, str] | None] = {}
        self._heads: dict[str, tuple[list[str], list[int]]] = {}
        self._totals: dict[str, int] = {}
        self._characters = 0
        self._follows: dict[tuple[str, str], bool] = {}
        if self.total(_PROBE) != len(model.encode(_PROBE)):
            raise ValueError("this model does not merge as the dynamic program expects")

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge last when ``piece`` is encoded alone; None if it is not met.

        The best pair merges first, of equals the leftmost.
        """
        if piece not in self._split:
            parts, last = list(piece), None
            while len(parts) > 1:
                scored = [
                    (-self._scores[a + b], i)
                    for i, (a, b) in enumerate(zip(parts, parts[1:]))
                    if a + b in self._scores
                ]
                if not scored:
                    break
                at = min(scored)[1]
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._split[piece] = last if len(parts) == 1 else None
        return self._split[piece]

    def _may_follow(self, before: str, piece: str) -> bool:
        """Whether merging ``before + piece`` never crosses from one to the other.

        Merges are taken back from the last to the first. Between two of them the parts at the
        border stand side by side, and would merge if their pair came before the next merge.
        """
        if len(piece) > 1 and self._halves(piece) is None:
            return False
        left, right = before, piece
        score, next_score, next_is_right = self._scores.get, -math.inf, False
        while left:
            pair = score(left + right)
            if pair is not None and (pair > next_score or pair == next_score and next_is_right):
                return False
            if len(left) == 1 and len(right) == 1:
                break
            # Of equal merges the right one comes later.
            next_is_right = len(left) == 1 or len(right) > 1 and score(right) <= score(left)
            if next_is_right:
                next_score, right = score(right), self._halves(right)[0]
            else:
                next_score, left = score(left), self._halves(left)[1]
        return True

    def _counts(self, symbols: str) -> list[int]:
        """Tokens of the first 0, 1, ... characters of a chunk that begins with a mark.

        Chunks that begin alike share the first entries of their tables.
        """
        scores, known, tails = self._scores, self._follows, self._tails
        last, counts = [""], [0]
        head = symbols[:_HEAD]
        shared = self._heads.get(head)
        if shared is not None:
            last, counts = shared[0][:], shared[1][:]
        for end in range(len(counts), len(symbols) + 1):
            for size in tails.get(symbols[end - 2 : end] if end > 1 else symbols[:1], ()):
                if size > end:
                    continue
                piece = symbols[end - size : end]
                if piece not in scores:
                    continue
                key = (last[end - size], piece)
                fits = known.get(key)
                if fits is None:
                    if len(known) >= _REMEMBERED_PAIRS:
                        known.clear()
                    fits = known[key] = self._may_follow(*key)
                if fits:
                    counts.append(counts[end - size] + 1)
                    break
            else:
                piece = symbols[end - 1]
                counts.append(counts[end - 1] + (1 if piece in scores else len(piece.encode())))
            last.append(piece)
            if end == _HEAD:
                if len(self._heads) >= _REMEMBERED_HEADS:
                    self._heads.clear()
                self._heads[head] = last[:], counts[:]
        return counts

    def _total(self, chunk: str) -> int:
        """Tokens of a chunk given without its first mark: the last entry of its table."""
        n = self._totals.get(chunk)
        if n is None:
            n = self._counts(_MARK + chunk.replace(" ", _MARK))[-1]
            if len(chunk) <= _LONG_CHUNK:
                self._characters += len(chunk)
                if len(self._totals) >= _REMEMBERED or self._characters > _REMEMBERED_CHARACTERS:
                    self._totals.clear()
                    self._characters = 0
                self._totals[chunk] = n
        return n

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each without its first mark; ``" ".join`` restores the text.

        Marks that precede a character belong to its chunk, marks at the end form one.
        """
        parts = text.replace(_MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, marks = [], 0
        for part in parts:
            if part:
                out.append(" " * marks + part)
                marks = 0
            else:
                marks += 1
        if marks:
            out.append(" " * (marks - 1))
        return out

    def total(self, text: str) -> int:
        """Tokens of a whole text: the last entry of its table, which need not be put together."""
        if not text:
            return 0
        chunks = self.chunks(text)
        found = list(map(self._totals.get, chunks))
        if None not in found:
            return sum(found)
        return sum(self._total(chunk) if n is None else n for chunk, n in zip(chunks, found))

    def table(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, ... characters: an entry for every prefix."""
        if not text:
            return np.zeros(1, dtype=np.int32)
        parts, before = [], 0
        for chunk in self.chunks(text):
            counts = self._counts(_MARK + chunk.replace(" ", _MARK))
            parts.append(np.array(counts[1:], dtype=np.int32) + np.int32(before))
            before += counts[-1]
        # The first mark of the text is not one of its characters; no prefix is that mark alone.
        whole = np.concatenate(parts)
        whole[0] = 0
        return whole

    @staticmethod
    def longest_prefix(table: np.ndarray, budget: int) -> int:
        """Most characters that can be kept so that no shorter prefix breaks the budget."""
        over = table > max(budget, 0)
        return int(over.argmax()) - 1 if over.any() else len(table) - 1


def _per_batch(path: str, limit: int, with_table: bool, budget: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        for batch in batches:
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "__text"]
            names = [n for n in batch.schema.names if n != "__text"]
            sizes, totals, tables, fits = [], [], [], []
            for value in batch.column("__text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                totals.append(counter.total(text))
                if with_table or budget is not None:
                    table = counter.table(text)
                    if with_table:
                        tables.append(table)
                    if budget is not None:
                        fits.append(counter.longest_prefix(table, budget))
            columns += [
                pa.array(sizes, pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([n > limit for n in totals], pa.bool_()),
            ]
            names += ["n_bytes", "n_tokens", "over_limit"]
            if with_table:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            if budget is not None:
                columns.append(pa.array(fits, pa.int64()))
                names.append("fits_chars")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = LIMIT,
    with_table: bool = False,
    budget: int | None = None,
) -> DataFrame:
    """Input columns but ``text``, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``with_table`` adds the stored table, ``prefix_tokens``: tokens of the first 0, 1, ...
    characters. ``budget`` adds ``fits_chars``, the characters that fit into so many tokens.
    """
    own = ["n_bytes", "n_tokens", "over_limit", "prefix_tokens", "fits_chars"]
    kept = [c for c in docs.columns if c not in (*own, "text", "__text")]
    extra = [T.StructField(n, T.LongType()) for n in own[:2]]
    extra.append(T.StructField("over_limit", T.BooleanType()))
    if with_table:
        extra.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    if budget is not None:
        extra.append(T.StructField("fits_chars", T.LongType()))
    schema = T.StructType([docs.schema[c] for c in kept] + extra)
    narrow = docs.select(*kept, F.col("text").alias("__text"))
    return narrow.mapInArrow(_per_batch(path, limit, with_table, budget), schema)
