import collections

import corpus_pipeline
from treeledger.llm import mixing, near_dedup, pii, piece_codec, quality
from treeledger.llm.common import table
from treeledger.llm.queries import QUERIES, SQL, piece_model_path

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in quality.classify(docs, table(spark, SF, "labels")).collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.5}
        elif n == 1:
            marked = near_dedup.deduplicate(spark.createDataFrame(before, docs.schema))
            assert {r.doc_id for r in after} == {r.doc_id for r in marked.collect() if r.kept}
        elif n == 2:
            assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text and pii.redact(r.text) for r in before}
            assert not any(pii.find(r.text)[1] for r in after)
        elif n == 3:
            times = collections.Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect())
            assert collections.Counter(r.doc_id for r in after) == times
        else:
            m = piece_codec.model(piece_model_path())
            assert collections.Counter((r.doc_id, r.n_tokens) for r in after) == collections.Counter((r.doc_id, len(m.encode(r.text))) for r in before)


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
