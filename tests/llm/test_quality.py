import zlib

import numpy as np

from treeledger.llm import quality
from treeledger.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, marks[r.doc_id], r.predicted) for r in rows if r.held_out and marks.get(r.doc_id) is not None]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([y == p for _, y, p in held]) > 0.95


def test_labels_held_out_are_never_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 3 = 1 THEN 1 - quality ELSE quality END as quality", "toxic")
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.network.w1, b.network.w1) and a.network.temperature == b.network.temperature


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 1.0), (None, "", "en", "s", 0, 2.0), (1, "a " * 50000, "en", "s", 0, 3.0)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 3
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 3
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_temperature_calibrates():
    rng = np.random.RandomState(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.rand(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.calibrate(3 * z, y) - 3) < 0.4


def brute_vectors(texts):
    signs = quality.index_signs()[:-1].astype(int)
    out = np.zeros_like(signs)
    for text in texts:
        rows = [quality.index_row(t) for t in quality.TOKEN.findall(text.lower())]
        for i, r in enumerate(rows):
            for j in range(max(0, i - quality.WINDOW), min(len(rows), i + quality.WINDOW + 1)):
                if j != i:
                    out[r] += signs[rows[j]]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.maximum(norm, 1e-9), signs / np.sqrt(quality.NONZERO))


def test_vectors_cover_all_documents_however_they_are_split(spark, monkeypatch):
    rng = np.random.RandomState(1)
    texts = [" ".join(rng.choice(["the", "Cat", "sat,", "on", "42", "mats__", "x"], rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute_vectors([t or "" for t in texts])
    monkeypatch.setattr(quality, "FAN", 2)
    for parts in (1, 5):
        assert np.allclose(quality.word_vectors(docs.repartition(parts)), want, atol=1e-6)


def test_contexts_of_long_texts_are_cut_at_fixed_places(monkeypatch):
    text = "one two three four five " * 400
    whole = quality.Contexts()
    whole.add(text)
    whole.flush()
    monkeypatch.setattr(quality, "TOKENS", 7)
    cut = quality.Contexts()
    cut.add(text)
    cut.flush()
    assert np.array_equal(whole.sums[:-1], cut.sums[:-1])
    monkeypatch.setattr(quality, "CHARACTERS", 10)
    assert " ".join("".join(quality.pieces(text)).split()) == text.strip()


def test_repeated_labels_and_long_texts_count_once_and_whole(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zzz 99 !! ") * (8000 if i < 4 else 5)) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    once, often = quality.fit(docs, labels), quality.fit(docs, labels.union(labels).union(labels))
    assert np.array_equal(once.network.w1, often.network.w1)
    rows = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    assert rows == {i: i % 2 for i in range(60)}


def test_columns_that_are_kept_may_clash(spark):
    docs = spark.createDataFrame([(1, "a", 0.3, "k")], "doc_id bigint, text string, score double, _text string")
    row = quality.scored(docs, quality.Classifier(np.zeros((quality.INDEX_ROWS, quality.DIMENSIONS), np.float32), None), keep=("score", "_text", "doc_id")).collect()
    assert [tuple(r) for r in row] == [(1, 0.5)]
