import collections

from treeledger.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, sizes):
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, "w " * (1 + n % 5), "en", source, 1))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_every_document_once_and_limit_held(spark):
    df = docs(spark, {"big": 400, "mid": 100, "small": 30, None: 20})
    rows = mixing.mix(df, most_epochs=3, block_words=100).collect()
    words = {r.doc_id: len(r.text.split()) for r in df.collect()}
    times = collections.Counter(r.doc_id for r in rows)
    assert set(times) == set(words) and max(times.values()) <= 3
    plan = {r.key: r for r in mixing.plan_sources(mixing.rows_of(df), 3.0).collect()}
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += words[r.doc_id]
    for source in ("big", "mid", "small", None):
        budget = plan["null" if source is None else f"={source}"].budget
        assert budget - 5 <= taken[source] <= budget
    assert abs(sum(p.weight for p in plan.values()) - 1) < 1e-9
    places = collections.defaultdict(list)
    for r in rows:
        places[r.block].append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_blocks_hold_the_target_weights(spark):
    df = docs(spark, {"a": 2000, "b": 500})
    rows = mixing.mix(df, most_epochs=2, block_words=1500).collect()
    share = collections.defaultdict(lambda: collections.Counter())
    for r in rows:
        share[r.block][r.source] += r.words
    parts = [c["b"] / sum(c.values()) for c in share.values()]
    assert max(parts) - min(parts) < 0.06


def test_entropy_target(spark):
    import math

    df = docs(spark, {"a": 600, "b": 100, "c": 40})
    plan = mixing.plan_sources(mixing.rows_of(df), most_epochs=1e9, target_entropy=0.9).collect()
    assert abs(-sum(p.weight * math.log(p.weight) for p in plan) - 0.9) < 0.01


def test_documents_follow_the_plan(spark):
    df = docs(spark, {"big": 200, "small": 20, None: 5}).withColumn("key", mixing.F.lit("clash"))
    times = collections.Counter(r.doc_id for r in mixing.mix(df).collect())
    df = df.withColumn("full", mixing.F.lit(1)).withColumn("upto_h", mixing.F.lit(2)).withColumn("_full", mixing.F.lit(3)).withColumn("doc", mixing.F.lit(4))
    made = mixing.mix_documents(df)
    assert made.columns == df.columns and {(r["key"], r["full"], r["upto_h"], r["_full"], r["doc"]) for r in made.collect()} == {("clash", 1, 2, 3, 4)}
    assert collections.Counter(r.doc_id for r in made.collect()) == times


def test_wordless_sources_are_dealt_to_all_blocks(spark):
    rows = [(i, "w " * 50, "en", "a", 1) for i in range(200)] + [(1000 + i, None, "en", "empty", 0) for i in range(400)]
    got = collections.Counter((r.source, r.block) for r in mixing.mix(spark.createDataFrame(rows, DOCS), block_words=2500).collect())
    blocks = {b for _, b in got}
    assert len(blocks) == 4 and all(50 < got["empty", b] < 150 for b in blocks)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (None, "x y", "en", None, 0), (2, "", "en", "b", 0), (3, "x", "en", "b", 0), (3, "x", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert mixing.mix(df).count() >= 5 and mixing.mix_documents(df).count() >= 5
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix_documents(df.limit(0)).collect() == []
    only = spark.createDataFrame([(1, "", "en", "a", 0)], DOCS)
    assert mixing.mix(only).count() == 1 and mixing.mix_documents(only).count() == 1
