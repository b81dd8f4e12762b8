import collections
import os
import random
import re

import numpy as np

from treeledger.llm import near_dedup as nd

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k=4):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def run(spark, rows, words=4):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    return nd.deduplicate(docs, words=words).collect()


def test_shingles_match_the_definition():
    random.seed(1)
    names = {}
    for _ in range(3000):
        text = "".join(random.choice(["a", "B", "b", " ", "\t", "\n", "é", "É", "ab", "\x85", "\x1c"]) for _ in range(random.randint(0, 25)))
        want = shingle_set(text, 4)
        got = nd.shingles(text, 4)
        assert len(got) == len(want)
        assert names.setdefault(want, nd.names(got)) == nd.names(got)
    assert len(set(names.values())) == len(names)


def test_groups_equal_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for base in range(12):
        text = [random.choice(words) for _ in range(random.choice([3, 12, 60, 200]))]
        for _ in range(random.randint(1, 14)):
            copy = list(text)
            for _ in range(random.randint(0, max(1, len(copy) // 20))):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " \t "), (n + 3, "One two"), (n + 4, "one TWO")]
    random.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)}
    assert got == brute(rows)


def test_near_copies_of_a_common_base_in_one_hot_bucket(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(900)]
    base = [random.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(random.choice([1, 3, 6])):
            copy[random.randrange(len(copy))] = random.choice(words)
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)}
    assert got == brute(rows)


def apart_rows():
    """Many texts that share half of their words, and so hot bands, without being near; among them pairs that are, away from the pivots."""
    random.seed(12)
    words = [f"w{i}" for i in range(5000)]
    common = [random.choice(words) for _ in range(70)]
    rows = []
    for i in range(120):
        own = common + [random.choice(words) for _ in range(40)]
        rows.append((2 * i, " ".join(own)))
        if i % 3 == 0:
            own[-1] = "other"
            rows.append((2 * i + 1, " ".join(own)))
    return rows


def test_hot_buckets_that_stay_apart_equal_brute_force(spark, monkeypatch):
    rows = apart_rows()
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 120
    for block, hot in ((1024, 512), (8, 4), (3, 2)):
        monkeypatch.setattr(nd, "BLOCK", block)
        monkeypatch.setattr(nd, "HOT", hot)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)} == want


def test_similar_sets_share_a_prefix():
    rng = np.random.RandomState(4)
    for _ in range(500):
        a = np.unique(rng.randint(0, 300, rng.randint(1, 60)))
        b = a.copy()
        for _ in range(rng.randint(0, 6)):
            b = np.unique(np.append(np.delete(b, rng.randint(len(b))) if len(b) > 1 else b, rng.randint(0, 300)))
        keys = np.unique(rng.randint(0, 300, 40))
        ranks = rng.permutation(len(keys)) + 1
        both = len(np.intersect1d(a, b))
        p, q = (set(nd.prefix(x.astype(np.int64), keys, ranks, 80).tolist()) for x in (a, b))
        assert len(p) == len(a) - -(-80 * len(a) // 100) + 1
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert p & q


def test_nothing_but_the_result_is_left(spark):
    from treeledger.llm import common

    got = nd.deduplicate(spark.createDataFrame([(i, "a b c d e", "en", "s", 1) for i in range(5)], DOCS))
    folder = got._scratch_path.rsplit("/", 1)[0]
    assert os.listdir(folder) == [got._scratch_path.rsplit("/", 1)[1]] and got.count() == 5
    common.clean_up(spark)
    assert not os.path.exists(folder)


def test_blocks_compare_whole_buckets():
    random.seed(2)
    sets = [np.array(sorted(random.sample(range(500), random.randint(1, 90))), dtype=np.int64) for _ in range(40)]
    common = nd.common_counts(sets[:15], sets[15:])
    assert all(common[i, j] == len(set(sets[i]) & set(sets[15 + j])) for i in range(15) for j in range(25))


def test_bounds_keep_what_is_similar():
    bounds = nd.least_agreeing(0.8)
    assert all(nd.reach_probability(b - 1, s, 0.8) < nd.MISS <= nd.reach_probability(b, s, 0.8) for b, s in zip(bounds, (32, 64, 96, 128)))


def test_nulls_repeats_and_other_columns(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame(
        [(1, text, "x"), (1, text, "y"), (None, text, "z"), (None, None, "z"), (5, "a b c d e f g h", None), (7, None, "q")], "doc_id bigint, text string, cls string"
    )
    got = collections.Counter(tuple(r) for r in nd.deduplicate(docs, words=4).collect())
    assert got == {(1, 5, 1, True): 2, (None, 5, 1, False): 1, (None, 0, None, False): 1, (5, 5, 1, False): 1, (7, 0, 7, True): 1}
    kept = nd.keep_one(docs, words=4)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert nd.deduplicate(docs).collect() == []
    assert nd.keep_one(docs).collect() == []


def plan_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0]


def test_texts_stay_where_they_are_if_few_ids_go(spark, monkeypatch):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(i, text if i < 5 else f"{text} {i} x y z", "en", "s", 1) for i in range(20)], DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of ids grow beyond any threshold
    try:
        few = nd.keep_one(docs)
        assert "SortMergeJoin" not in plan_of(few)
        monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
        many = nd.keep_one(docs)
        assert "SortMergeJoin" in plan_of(many)
        assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 16
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_of_the_same_members_are_compared_once(spark):
    sets = spark.createDataFrame([(i, list(range(20)) + [100 + i]) for i in range(3)] + [(3, list(range(500, 520)))], "cls bigint, shingles array<bigint>")
    rows = spark.createDataFrame([(key, i, i) for key, members in ((7, (0, 1)), (8, (0, 1)), (9, (0, 1, 2)), (10, (0, 3))) for i in members], "key bigint, cls bigint, label bigint")
    assert sorted(map(tuple, nd.block_links(rows, sets, 80).collect())) == [(0, 1), (0, 1), (0, 2)]
