"""Learned operators on held-out rows, token counts against the library, vectors, the pipeline."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stallworks.llm import embedding_dedup as vectors
from stallworks.llm import queries, toxicity
from stallworks.llm.embedding_dedup import embedding_duplicates
from stallworks.llm.language_id import identified
from stallworks.llm.near_dedup import band_hashes, super_minhash
from stallworks.llm.quality import quality_scores
from stallworks.llm.sampling import bounded_sample
from stallworks.llm.text import span_hashes, spans, text_blocks
from stallworks.llm.token_counts import PrefixCounter, model_path, token_counts
from stallworks.llm.toxicity import label_posterior, toxicity_scores
from tests.llm import reference

ODD = [
    "a  b", " a", "a ", "", "  ", "\n", "a\nb", "<s>", "▁a", "a▁ b", "　x", "\x00a", "a\tb", " ",
    "   x  y   ", "é ñ😀", "<unk></s> <0x0A>", "x" * 5000, "word " * 500, "\r\n\r\n", "ﬁ Å",
]


DIGITS = str.maketrans("0123456789", "ghijklmnop")  # only letters make a token


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(model_path())


def test_token_counts_equal_the_library(spark, check_dir, counter):
    got = queries.op4_token_counts(spark, check_dir).collect()
    texts = dict(
        map(tuple, spark.read.parquet(f"{check_dir}/documents.parquet").select("doc_id", "text").collect())
    )
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(counter.model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)


def test_every_prefix_is_exact(counter):
    rng = np.random.default_rng(7)
    parts = list("aeioutnrsl  <>▁▁/é中😀\n\r\t0123ABC.,;") + ["the ", "ing", "tion", " and", "   ", "ﬁ", "　"]
    mixed = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(300)]
    for text in [*ODD, *mixed, "Some words,\nand  more▁words \t of  all kinds  "]:
        table = counter.table(text)
        assert len(table) == len(text) + 1 and table[-1] == counter.total(text)
        for n in range(len(text) + 1) if len(text) < 100 else (1, 777, 2000, len(text)):
            assert table[n] == len(counter.model.encode(text[:n]))


def test_tables_hold_when_memory_is_full(counter, monkeypatch):
    from stallworks.llm import token_counts as module

    for name in ("_REMEMBERED", "_REMEMBERED_PAIRS", "_REMEMBERED_HEADS"):
        monkeypatch.setattr(module, name, 3)
    text = "words that are longer than heads, thatched and that are not met again " * 3
    assert counter.total(text) == len(counter.model.encode(text)) == counter.table(text)[-1]


def test_odd_texts_and_budgets(spark, counter):
    rows = [(i, t, "x", 3) for i, t in enumerate([*ODD, None])]
    docs = frame(spark, rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = token_counts(docs, model_path(), limit=10, with_table=True, budget=3).orderBy("doc_id").collect()
    for r, (_, text, _, _) in zip(got, rows):
        text = text or ""
        assert r.n_tokens == len(counter.model.encode(text)) and r.over_limit == (r.n_tokens > 10)
        assert len(r.prefix_tokens) == len(text) + 1 and r.prefix_tokens[-1] == r.n_tokens
        assert len(counter.model.encode(text[: r.fits_chars])) <= 3
        if r.fits_chars < len(text):
            assert len(counter.model.encode(text[: r.fits_chars + 1])) > 3
    assert token_counts(frame(spark, [], "doc_id long, text string"), model_path()).count() == 0


def test_spans_and_hashes():
    texts = ["a bc\td", "", None, " x ", "bc\x0b\x0cA", "é " * 3, "long" * 400_000 + " bc"]
    import pyarrow as pa

    seen = {}
    for row, data, offsets in text_blocks(pa.array(texts)):
        starts, lengths, before = spans(data, offsets)
        hashes = span_hashes(data, starts, lengths)
        for i in range(len(offsets) - 1):
            at = slice(before[i], before[i + 1])
            found = [bytes(data[s : s + n]).decode() for s, n in zip(starts[at], lengths[at])]
            assert found == reference.words(texts[row + i])
            for word, h in zip(found, hashes[at]):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    slots = 96
    for n, shared in ((300, 240), (40, 20), (5, 4), (1, 1)):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = pool[:n], pool[n - shared :]
            owner = np.repeat([0, 1], [n, n])
            signature = super_minhash(np.concatenate([a, b]), owner, 2, slots)
            assert (signature >> np.uint64(32)).max() < slots  # every slot is filled
            errors.append((signature[0] == signature[1]).mean() - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03
        # Not above the variance of independent permutations.
        j = shared / (2 * n - shared)
        assert np.std(errors) <= 1.4 * math.sqrt(max(j * (1 - j), 1e-9) / slots)
    keys = band_hashes(super_minhash(np.zeros(0, np.uint64), np.zeros(0, int), 2, slots), 24, 4)
    assert keys.shape == (2, 24) and (keys[0] == keys[1]).all()


def held_out(spark, folder, query, value, modulus, rest):
    got = query(spark, folder)
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % modulus == rest)).count() == 0
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", value)
    rows = got.where("held_out").join(truth, "doc_id").select("score", "predicted", value).collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    good = np.array([r.score for r in rows if r[value] == 1])
    bad = np.array([r.score for r in rows if r[value] == 0])
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


@pytest.fixture(scope="module")
def large_dir(check_dir):
    return check_dir.replace("sf0.01", "sf0.1")


def test_toxicity_on_held_out_rows(spark, large_dir):
    assert held_out(spark, large_dir, queries.op2_toxicity, "toxic", 4, 2) > 0.95


def test_quality_on_held_out_rows(spark, large_dir):
    assert held_out(spark, large_dir, queries.op7_quality, "quality", 5, 0) > 0.98


def test_language_on_held_out_rows(spark, check_dir):
    got = queries.op6_language(spark, check_dir)
    truth = spark.read.parquet(f"{check_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_label_model_recovers_accuracies():
    """Hidden classes, independent voters and one voter copied three times."""
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.2
    fires, errs = np.array([0.6, 0.5, 0.3]), np.array([0.02, 0.05, 0.01])
    votes = (rng.random((3000, 3)) < np.where(y[:, None], fires, errs)).astype(float)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])
    given = np.where(rng.random(3000) < 0.05, ~y, y).astype(float)
    posterior, damp = label_posterior(votes, given)
    assert ((posterior > 0.5) == y).mean() >= (given == y).mean() - 0.005
    assert damp[0] == pytest.approx(1 / 3, abs=0.05) and damp[1] > 0.7


def test_toxicity_fits_on_all_rows_but_only_on_picked_features(spark, monkeypatch):
    """6,000 labelled rows of words that are mostly met once, and 30 that tell the classes apart."""
    seen, fit = [], toxicity.fit

    def spy(ids, rows, toxic, *picked):
        seen.append((ids, toxic))
        return fit(ids, rows, toxic, *picked)

    monkeypatch.setattr(toxicity, "fit", spy)
    data = [
        (i, " ".join(f"{'xy'[i % 2]}{chr(97 + (i // 2 + j) % 15)}" for j in range(2))
            + "".join(f" w{chr(97 + i % 26)}{hex(i * 40 + j)[2:].translate(DIGITS)}" for j in range(40)), i % 2)
        for i in range(6000)
    ]
    docs = frame(spark, data, "doc_id long, text string, toxic int")
    scored = toxicity_scores(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert scored.join(docs, "doc_id").where("predicted <> toxic").count() == 0
    ((ids, toxic),) = seen
    assert len(toxic) == 6000
    assert len(np.unique(ids)) <= toxicity.VOTERS + toxicity.CLEAN_FEATURES
    assert len(ids) < 20 * 6000


LEARNED = (
    (toxicity_scores, "toxic"),
    (quality_scores, "quality"),
)


@pytest.mark.parametrize("score, value", LEARNED)
def test_scorers_on_edge_rows(spark, score, value):
    docs = frame(
        spark,
        [(1, None, "s", 1.0), (2, "", "s", 1.0), (None, "x" * 300_000, "s", 1.0), (3, "bad bad", None, 0.0)] * 2,
        "doc_id long, text string, source string, score double",
    )
    for rows in ([], [(3, 1)], [(3, None), (None, 1)], [(1, 0), (2, 0), (3, 1)], [(1, 1), (77, 0)]):
        labels = frame(spark, rows, f"doc_id long, {value} int")
        got = score(docs, labels)
        assert got.columns == ["doc_id", "source", "score", "predicted"]
        assert got.where("score BETWEEN 0 AND 1").count() == 8
    empty = frame(spark, [], "doc_id long, text string")
    assert score(empty, frame(spark, [(1, 1)], f"doc_id long, {value} int")).count() == 0


def test_language_on_edge_rows(spark):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 !!", "ЖЖЖ", "x" * 200_000]
    docs = frame(spark, [(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    known = frame(
        spark,
        [(1, texts[0], "en"), (2, texts[1], "fr"), (3, "le la", None), (4, None, "fr"), (None, "der", "de")],
        "doc_id long, text string, lang string",
    )
    got = [(r.lang_pred, r.score) for r in identified(docs, known).orderBy("doc_id").collect()]
    assert [p for p, _ in got[:5]] == ["en", "fr", "und", "und", "und"] and got[2][1] == 0
    assert got[5][0] in ("en", "fr")
    none = identified(docs, known.where("false")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def plain_grams(text):
    """Counts of the bins of all three and four characters, one by one."""
    from stallworks.llm.language_id import BINS, gram_bins

    shown = [" ", *("".join(c.lower() if c.isalpha() else " ") if c < "\x80" else c for c in text), " "]
    counts = np.zeros(BINS, dtype=np.int64)
    for n in (3, 4):
        for i in range(len(shown) - n + 1):
            codes = np.array([ord(c) for c in shown[i : i + n]], dtype=np.uint32)
            counts[gram_bins(codes)[n - 3][0]] += 1
    return counts


def test_language_equals_plain_naive_bayes(spark, monkeypatch):
    from stallworks.llm import language_id

    monkeypatch.setattr(language_id, "_GROUP_BYTES", 700)  # long texts are cut into pieces
    rng = np.random.default_rng(5)
    words = {"en": ["the", "cat", "and", "dog"], "ru": ["кот", "и", "пёс", "дом"], "zh": ["中文", "语言", "的"]}
    rows = []
    for i in range(150):
        lang = ["en", "ru", "zh"][i % 3]
        text = " ".join(rng.choice(words[lang if rng.random() < 0.9 else "en"], rng.integers(1, 15)))
        rows.append((i, text * (60 if i % 50 == 0 else 1) + "X1", lang))
    texts = {i: t for i, t, _ in rows}
    counts = {i: plain_grams(t) for i, t in texts.items()}
    assert len(next(language_id._pieces(np.frombuffer(texts[50].encode(), np.uint8)))) < len(texts[50].encode())
    for i, t in texts.items():
        data = np.frombuffer(t.encode(), np.uint8)
        assert (language_id._long_counts(data) == counts[i]).all()
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    known = docs.where("doc_id % 2 = 0")
    langs = sorted(words)
    prior = np.log([sum(1 for i, _, x in rows if x == lang and i % 2 == 0) / 75 for lang in langs])
    matrix = np.stack([sum(counts[i] for i, _, x in rows if x == lang and i % 2 == 0) + 0.1 for lang in langs])
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    found = identified(docs.drop("lang"), known).collect()
    assert len(found) == len(rows)
    for r in found:
        total = prior + logs @ counts[r.doc_id]
        assert r.lang_pred == langs[int(total.argmax())]
        assert r.score == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-9)


def test_more_languages_than_a_task_or_the_model_holds(spark, monkeypatch):
    from stallworks.llm import language_id

    monkeypatch.setattr(language_id, "_TASK_LANGUAGES", 2)
    monkeypatch.setattr(language_id, "LANGUAGES", 5)
    rows = [(100 * n + i, f"{chr(97 + n) * 4} word", f"l{n}") for n in range(8) for i in range(20 - n)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    langs, prior, logs = language_id.fit(docs)
    assert langs == ["l0", "l1", "l2", "l3", "l4"] and logs.shape == (language_id.BINS, 5)
    assert np.exp(prior) == pytest.approx(np.array([20, 19, 18, 17, 16]) / 90)


def test_quality_network_equals_plain_loops():
    from stallworks.llm import quality

    rng = np.random.default_rng(6)
    w = quality.initial(3)
    w["bias"] += rng.normal(0, 0.1, w["bias"].shape).astype(np.float32)

    def plain(data):
        data = bytes(data).ljust(quality.WIDTH, b"\0")
        at = range(len(data) - quality.WIDTH + 1)
        hits = np.array([sum(w["table"][j, data[i + j]].astype(float) for j in range(quality.WIDTH)) for i in at])
        half = quality.HALF_CHUNK
        starts = range(0, max(len(hits) - half, 1), half)
        chunks = np.array([np.maximum(hits[s : s + 2 * half].max(axis=0) + w["bias"], 0) for s in starts])
        pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
        hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"][0])))

    for n in (0, 1, 4, 5, 6, 131, 132, 133, 260, 261, 1000, 9000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        assert quality.probability(data, w) == pytest.approx(plain(data), abs=1e-4)


HELD_OUT = ((queries.op2_toxicity, "toxic", 4, 2), (queries.op7_quality, "quality", 5, 0))


@pytest.mark.parametrize("query, value, modulus, rest", HELD_OUT)
def test_held_out_labels_are_never_learned(spark, small_dir, tmp_path, query, value, modulus, rest):
    """Turning the labels of held-out rows, and renaming lang and source, changes no score."""
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    hidden = F.crc32(F.col("doc_id").cast("string")) % modulus == rest
    labels.withColumn(value, F.when(hidden, 1 - F.col(value)).otherwise(F.col(value))).write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}).write.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.score for r in query(spark, small_dir).collect()}
    after = {r.doc_id: r.score for r in query(spark, str(tmp_path)).collect()}
    assert before.keys() == after.keys()
    assert list(before.values()) == pytest.approx([after[d] for d in before], abs=1e-6)


def test_label_samples_are_bounded_for_repeated_ids_and_by_bytes(spark):
    from stallworks.llm.sampling import labelled_sample

    texts = frame(spark, [(1, f"t{i}") for i in range(3000)] + [(2, "y")] * 50 + [(3, "z" * 5000)], "doc_id long, text string")
    labels = frame(spark, [(1, 1)] * 4000 + [(2, 0), (3, 1)], "doc_id long, toxic int")
    assert 150 < labelled_sample(texts, labels, "toxic", 300).count() < 450
    everything = labelled_sample(texts, labels, "toxic", 5000)
    assert everything.count() == 3002 and everything.where("doc_id = 2").count() == 1
    small = labelled_sample(texts, labels, "toxic", 5000, 6400)
    n_bytes = small.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 4000 < n_bytes < 9000 and small.where("doc_id = 3").count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    first = {r.doc_id for r in bounded_sample(rows, "doc_id", 1000).collect()}
    assert 850 < len(first) < 1150
    assert first == {r.doc_id for r in bounded_sample(rows.repartition(7), "doc_id", 1000).collect()}


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 8)) * 1.5
    found = vectors.nearest_lattice(points)
    best = ((points - found) ** 2).sum(axis=1)
    assert len(vectors.roots()) == 240 and np.allclose((vectors.roots() ** 2).sum(axis=1), 2)
    for root in vectors.roots():
        assert (((points - found - root) ** 2).sum(axis=1) >= best - 1e-9).all()
    doubled = np.rint(found * 2)
    assert np.allclose(doubled, found * 2) and (np.rint(found.sum(axis=1)) % 2 == 0).all()


def brute_links(unit: np.ndarray) -> np.ndarray:
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    return linked


def test_embedding_links(spark):
    """Pairs at many distances around the threshold, a hot group over several blocks."""
    rng = np.random.default_rng(4)

    def near(v, cosine):
        other = rng.normal(size=v.shape)
        other -= (other @ v) * v / (v @ v)
        return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)

    base = rng.normal(size=(300, 64))
    rows = list(base)
    planted = []
    for i in range(300):
        planted.append((i, len(rows)))
        rows.append(near(base[i], 0.9 + 0.0999 * i / 300) * rng.uniform(0.1, 9))
    rows += [near(base[0], 0.97) for _ in range(150)] + [base[1] * 2.0] * 40
    unit = np.stack(rows) / np.linalg.norm(np.stack(rows), axis=1, keepdims=True)
    linked = brute_links(unit)
    data = [(i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    found = embedding_duplicates(
        frame(spark, data, "vec_id long, embedding array<double>, n_links int"), block=50
    ).collect()
    got = {r.vec_id: r for r in found}
    # Links that are found are all of a component; nearly all components are found.
    total = sum(r.n_links for r in found)
    assert 0.97 * linked.sum() <= total <= linked.sum()
    missed = [p for p in planted if linked[p] and got[p[0]].component_id != got[p[1]].component_id]
    assert len(missed) <= 6
    assert all(got[i].n_links <= linked[i].sum() for i in got)
    want = reference.groups(range(len(rows)), np.argwhere(linked).tolist())
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.97
    for r in found:
        assert r.kept == (r.vec_id == r.component_id)


def test_embedding_edge_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []),
        (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]),
        (9, [1.0, 0.0, 0.0]), (10, [1e-200, 0.0]), (11, [1e200, 1e190]),
    ]
    got = embedding_duplicates(frame(spark, rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: tuple(r)[1:] for r in got}
    for i in (1, 2, 10, 11):
        assert by_id[i] == (4, 1, i == 1)
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert by_id[i] == (0, i, True)
    assert by_id[None] == (0, None, True)
    empty = frame(spark, [], "vec_id long, embedding array<float>")
    assert embedding_duplicates(empty).count() == 0


def test_pipeline_stages(spark, check_dir, tmp_path):
    """Each stage on its own input, against brute force."""
    docs = spark.read.parquet(f"{check_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], check_dir).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert [df.columns for df in seen[:5]] == [columns] * 5
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in seen]

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{check_dir}/labels.parquet").collect()}
    dropped = {d for d, _ in rows[0]} - {d for d, _ in rows[1]}
    learned = [d for d in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    assert np.mean([(d in dropped) == (labels[d] == 1) for d in learned]) > 0.97

    want = reference.groups([d for d, _ in rows[1]], reference.near_links(rows[1], 5, 80))
    assert {d for d, _ in rows[2]} == {d for d in want if want[d] == d}

    cut = reference.cut_words(rows[2], 50)
    assert dict(rows[3]) == {
        d: " ".join(cut[d][0]) if any(cut[d][1]) else t for d, t in rows[2]
    }
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{check_dir}/benchmark.parquet").collect()]
    suspects = [(d, t) for d, t in rows[3] if d % 10 == 0 or d not in dict(rows[4])]
    found = {d for d, _ in reference.leaks([s for s in suspects if len(s[1]) < 3000], items)}
    gone = {d for d, _ in rows[3]} - {d for d, _ in rows[4]}
    assert {d for d, t in suspects if len(t) < 3000 and d in gone} == found

    mix = seen[5].collect()
    total = sum(len(reference.words(t)) for _, t in rows[4])
    assert 1.4 * total < sum(r.size * r.times for r in mix) <= 1.5 * total


def test_pipeline_on_empty_documents(spark, check_dir):
    docs = spark.read.parquet(f"{check_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, check_dir).count() == 0


def test_pipeline_stages_keep_odd_rows_and_clashing_columns(spark, check_dir):
    """NULLs in any column, repeated rows, empty texts, and columns named like those of a stage."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (1, None, None, None, 42.5, "p", 7), (2, "", "en", "s", None, None, None), (None, "no id here", None, "s", 1.0, "q", 1),
        (5, long, "en", "s", 2.0, "r", 2), (5, long, "en", "s", 2.0, "r", 2), (6, "short and clean text", "en", None, 3.0, "t", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, score double, predicted string, n_chars long"
    docs = frame(spark, rows, schema)

    def after(stage):
        return sorted(map(tuple, stage(spark, docs, check_dir).select(docs.columns).collect()), key=repr)

    everything = sorted(rows, key=repr)
    assert after(corpus_pipeline.reject_toxic) == everything
    assert after(corpus_pipeline.decontaminate) == everything
    assert after(corpus_pipeline.drop_near_duplicates) == everything
    cut = corpus_pipeline.cut_repeats(spark, docs, check_dir)
    assert cut.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.score) for r in cut.collect()), key=repr) == sorted(
        ((r[0], r[1], r[4]) for r in rows), key=repr
    )
    mixed = corpus_pipeline.mix_sources(spark, docs, check_dir)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.where("times > 2").count() == 0


def test_vectors_under_a_shared_id_lose_no_link(spark):
    rng = np.random.default_rng(41)
    b, c = rng.normal(size=(2, 64))
    b, c = b / np.linalg.norm(b), c / np.linalg.norm(c)

    def beside(v):
        other = rng.normal(size=64)
        other -= (other @ v) * v
        return 0.998 * v + math.sqrt(1 - 0.998**2) * other / np.linalg.norm(other)

    rows = [(3, b), (3, c), (7, beside(b)), (8, beside(c)), (11, rng.normal(size=64))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(table).collect())
    assert found == [(3, 1, 3, True), (3, 1, 3, True), (7, 1, 3, False), (8, 1, 3, False), (11, 0, 11, True)]
