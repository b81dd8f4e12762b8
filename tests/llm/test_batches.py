import tracemalloc

import pyarrow as pa
import pytest

from treeledger.llm import common, near_dedup, pii

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


class Frame:
    """Stands for documents; keeps the function that mapInArrow gets."""

    def __init__(self, session):
        self.sparkSession = session

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), *[pa.array(["x"] * n)] * 2, pa.array([None if t is None else len(t) for t in texts], pa.int64())], NAMES)


def test_redaction_holds_a_part_of_a_batch(spark):
    """A worker made Python objects of a whole batch, here 14 MB of texts and as much of redacted ones."""
    run = pii.redact_table(Frame(spark)).run
    own = batch(["Write to mail@example.com " + "word " * 700] * 4_000)
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([own])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4_000 and peak < 8e6


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_parts_are_the_batch(monkeypatch, size):
    monkeypatch.setattr(common, "BATCH_BYTES", size)
    own = batch([None, "", "é" * 400, "a", *["bc"] * 50, None, "d" * 999]).slice(1)
    lists = pa.RecordBatch.from_arrays([pa.array([[i] * (i % 7) for i in range(90)], pa.list_(pa.int64()))], ["x"])
    for whole in (own, own.slice(0, 0), lists):
        cut = list(common.parts(iter([whole])))
        assert pa.Table.from_batches(cut, whole.schema).equals(pa.Table.from_batches([whole]))
        assert all(b.num_rows == 1 or b.column(-1).type != pa.int64() or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= size for b in cut)


def test_the_session_sends_small_batches(spark):
    before = spark.conf.get(common.MOST_BYTES)
    try:
        near_dedup.sketches(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), 5)
        assert int(spark.conf.get(common.MOST_BYTES)) == common.BATCH_BYTES
        spark.conf.set(common.MOST_BYTES, "4k")
        docs = spark.createDataFrame([(i, "w" * 100) for i in range(500)], "doc_id bigint, text string").coalesce(1)
        found = common.mapped(docs, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches), "n bigint").collect()
        assert spark.conf.get(common.MOST_BYTES) == "4k" and len(found) > 5 and sum(r.n for r in found) == 500
    finally:
        spark.conf.set(common.MOST_BYTES, before)
