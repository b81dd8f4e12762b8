"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass makes each document's set of word shingles, its 128 minima, and two sums that name the
   set. Documents with equal sets form a class, known by its smallest doc_id.
2. The minima of each class are cut into 32 bands of 4. Classes that agree on a band share a
   bucket; at a similarity of 0.8 a pair shares no bucket once in 20 million.
3. Links are only needed until all that are linked hang together. So each bucket first compares its
   members with two pivots, its smallest and its largest class: these pairs grow with the
   members, not with their square.
4. A pair is verified in batches of 32 minima. After each batch the posterior of the similarity,
   with a flat prior, is Beta(1 + agreeing, 1 + differing); a pair is dropped once the
   probability of reaching the threshold falls below ``MISS``. Survivors are checked on the
   full shingle sets.
5. Components come from rounds of smallest-neighbour labels over the links, in DataFrames.
6. Buckets of more than ``BLOCK`` members that don't hang together by then get up to ``ROUNDS`` more pivots, taken by a hash, so
   that the members of a large group of near copies find each other at a cost in proportion to their number.
7. Buckets of three or more whose members still don't hang together are compared whole. The members of larger ones than ``BLOCK``,
   as of texts that share a long passage, first go to smaller buckets by the prefixes of their shingles: the shingles in the
   order of their number among these members, frequent ones last; two sets at the threshold always share one of the first
   ``n - threshold * n + 1`` of each. That is exact, and rows are in proportion to the texts. What is still larger is compared in blocks
   of bounded size: a task holds two blocks as bit sets over the shingles that they share and
   counts common shingles exactly. It puts out only links that join labels, no pairs. So no pair that shares a
   bucket stays untested, unless its ends hang together already.

Equal classes are made one by aggregation before the shuffle. Of a hot bucket the members never meet in one task: buckets of more
than ``hot_size`` members are so few that their ends can be broadcast, and the members are joined with them where they
are; all others are joined by a shuffle. Only numbers of rows reach the driver.

Defined cases: a null or wordless text has an empty set, links with nothing and is kept; rows that
repeat a doc_id are documents of their own, and are all kept or not by that doc_id; a null
doc_id takes the component of its exact copies, if any, is never near-linked and never kept; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, mapped

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
BATCH, MISS = 32, 1e-6
#: Members and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Ids that may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 250_000
#: A bucket is hot with so many members, and with more where such buckets could be more than HOT_BUCKETS.
HOT, HOT_BUCKETS = 512, 50_000
ROUNDS = 4

SKETCH = "doc_id bigint, n bigint, d1 bigint, d2 bigint, minima array<int>"
SETS = "doc_id bigint, d1 bigint, d2 bigint, shingles array<bigint>"

U = np.uint64
_rng = np.random.RandomState(20240607)
BYTE_CODES = _rng.randint(1, 2**63, 256, dtype=np.int64).astype(U)
BASE = U(6364136223846793005)
INVERSE = U(pow(6364136223846793005, -1, 2**64))
PLACE = (_rng.randint(1, 2**62, 64, dtype=np.int64).astype(U) << U(1)) | U(1)
FACTORS = (_rng.randint(1, 2**62, HASHES, dtype=np.int64).astype(U) << U(1)) | U(1)
OFFSETS = _rng.randint(1, 2**63, HASHES, dtype=np.int64).astype(U)
LOWER = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.concatenate([[U(1)], np.full(size - 1, BASE)]).cumprod(dtype=U)
            self.down = np.concatenate([[U(1)], np.full(size - 1, INVERSE)]).cumprod(dtype=U)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the shingles of ``words`` words; of fewer words, one number of them all."""
    data = np.frombuffer((text or "").encode().translate(LOWER), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=U)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=U)
    up, down = POWERS.upto(len(data) + 1)
    total = np.concatenate([[U(0)], np.cumsum(BYTE_CODES[data] * up[:-1], dtype=U)])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    n = len(word)
    if n < words:
        return mix(np.array([(word * PLACE[:n]).sum(dtype=U) + U(n)], dtype=U))
    out = np.zeros(n - words + 1, dtype=U)
    for i in range(words):
        out += word[i : n - words + 1 + i] * PLACE[i]
    return np.unique(mix(out + U(words)))


def minima(numbers: np.ndarray) -> np.ndarray:
    """The minima of a set, 31 bits each."""
    best = np.full(HASHES, U(2**64 - 1))
    for i in range(0, len(numbers), 2048):
        best = np.minimum(best, (numbers[None, i : i + 2048] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1))
    return (best >> U(33)).astype(np.int32)


def names(numbers: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set."""
    return int(mix(numbers + U(0x9E3779B97F4A7C15)).sum(dtype=U).astype(np.int64)), int(np.bitwise_xor.reduce(mix(numbers * U(3) + U(1))).astype(np.int64)) if len(numbers) else 0


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, least = [], [], [], []
            for text in batch.column(1).to_pylist():
                numbers = shingles(text, words)
                a, b = names(numbers)
                sizes.append(len(numbers))
                first.append(a)
                second.append(b)
                least.append(minima(numbers))
            flat = pa.array(np.concatenate(least) if least else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * HASHES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists], ["doc_id", "n", "d1", "d2", "minima"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SKETCH)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                named = [names(s) for s in sets]
                flat = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in named], pa.int64()), pa.array([b for _, b in named], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], ["doc_id", "d1", "d2", "shingles"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SETS)


def reach_probability(agreeing: int, seen: int, threshold: float) -> float:
    """Posterior probability that the similarity is at least the threshold."""
    # The Beta tail as a binomial sum: P(Beta(a, b) >= t) = P(Binomial(a + b - 1, t) <= a - 1).
    return sum(math.comb(seen + 1, k) * threshold**k * (1 - threshold) ** (seen + 1 - k) for k in range(agreeing + 1))


@lru_cache(maxsize=8)
def least_agreeing(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each batch, the agreeing minima below which a pair is dropped."""
    return tuple(next(m for m in range(seen + 1) if reach_probability(m, seen, threshold) >= miss) for seen in range(BATCH, HASHES + 1, BATCH))


def prune(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs a, b with minima ma, mb, those that no batch drops."""
    bounds = least_agreeing(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES) for i in (2, 3))
            alive = np.arange(batch.num_rows)
            agreeing = np.zeros(batch.num_rows, dtype=np.int64)
            for k, bound in enumerate(bounds):
                part = slice(k * BATCH, (k + 1) * BATCH)
                agreeing[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[agreeing[alive] >= bound]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], ["a", "b"])

    return mapped(pairs.select("a", "b", "ma", "mb"), run, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label: the smallest id reachable, of every id that is in a link a, b."""
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("id", "other"))
    labels = scratch.keep(both.groupBy("id").agg(F.least(F.min("other"), F.min("id")).alias("label")))
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("id").agg(F.min("near").alias("near"))
        seen = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("jump"))
        new = scratch.keep(seen.join(jump, "via", "left").select("id", "old", F.least("via", F.coalesce("jump", "via")).alias("label")))
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        scratch.drop(labels)
        labels = new.select("id", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            scratch.drop(both)
            return labels


def deduplicate(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    percent = round(threshold * 100)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sketch = scratch.keep(sketches(docs, words))
    named = ["n", "d1", "d2"]
    # Equal sets have equal minima, so a class takes its minima along and nothing is joined for them.
    classes = scratch.keep(sketch.where("n > 0").groupBy(named).agg(F.min("doc_id").alias("cls"), F.count("*").alias("size"), F.first("minima").alias("minima")))
    copied = hot_size(classes)
    own = join_buckets(sketch.where("n > 0").drop("minima"), classes.drop("minima"), copied, named)
    named_rows = scratch.keep(own.select("doc_id", "n", "cls").union(sketch.where("n = 0").select("doc_id", "n", F.lit(None).cast("bigint"))))
    scratch.drop(sketch)
    reps = classes.where("cls is not null").select("cls", *named, "minima")
    band = lambda i: F.xxhash64(i, F.slice("minima", i * ROWS + 1, ROWS))
    keyed = reps.select("cls", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("size")).where("low < high"))
    hot = hot_size(shared)
    buckets = scratch.keep(join_buckets(keyed, shared, hot))

    sets = member_sets(docs, reps, buckets, words, scratch)
    ends = buckets.select(F.explode(F.array(F.array("cls", "low"), F.array("cls", "high"))).alias("e"))
    pairs = scratch.keep(ends.select(F.least(F.col("e")[0], F.col("e")[1]).alias("a"), F.greatest(F.col("e")[0], F.col("e")[1]).alias("b")).where("a < b").distinct())
    links = scratch.keep(verify(pairs, reps, sets, threshold, percent, scratch))
    labels = components(links, scratch)
    for seed in range(ROUNDS):
        large = scratch.keep(apart(buckets.where(F.col("size") > BLOCK), labels, hot))
        if not large.limit(1).count():
            break
        found = scratch.keep(verify(scratch.keep(new_pivots(large, seed, hot)), reps, sets, threshold, percent, scratch))
        if not found.limit(1).count():
            break
        links = scratch.keep(links.union(found))
        labels = components(links, scratch)
    more = scratch.keep(block_links(scratch.keep(split_buckets(scratch.keep(apart(buckets, labels, hot)), sets, percent, scratch)), sets, percent))
    if more.limit(1).count():
        labels = components(links.union(more), scratch)

    found = named_rows.join(labels.select(F.col("id").alias("cls"), "label"), "cls", "left")
    component = F.coalesce("label", "cls", "doc_id")
    out = scratch.keep(
        found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
    )
    scratch.drop_but(out)
    return out


def member_sets(docs: DataFrame, reps: DataFrame, buckets: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """cls, shingles of every class that shares a bucket, from the text of its smallest doc_id."""
    wanted = scratch.keep(reps.drop("minima").join(buckets.select("cls").distinct(), "cls", "left_semi"))
    named = wanted.select(F.col("cls").alias("doc_id"), "d1", "d2")
    texts = of_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), named.select("doc_id").distinct())
    found = full_sets(texts, words).join(sendable(named), ["doc_id", "d1", "d2"], "left_semi")
    sets = scratch.keep(found.select(F.col("doc_id").alias("cls"), "shingles"))
    # Only rows that repeat a doc_id give a class more than one set; the sets are moved only then.
    if not sets.groupBy("cls").count().where("count > 1").limit(1).count():
        return sets
    once = scratch.keep(sets.dropDuplicates(["cls"]))
    scratch.drop(sets)
    return once


def sendable(ids: DataFrame) -> DataFrame:
    """Rows of ids, marked to be broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def of_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows (or with left_anti all others) whose id is among the ids, a table of one column; texts and sets stay where they are if ids are few."""
    return rows.join(sendable(ids), ids.columns[0], how)


def verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs a < b of classes, those that are similar enough."""
    ends = lambda x: x.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    near = scratch.keep(of_ids(reps.select("cls", "minima"), scratch.keep(ends(pairs))))
    with_minima = pairs.join(near.toDF("a", "ma"), "a").join(near.toDF("b", "mb"), "b")
    alive = scratch.keep(prune(with_minima, threshold))
    scratch.drop(near)
    held = of_ids(sets, scratch.keep(ends(alive)))
    joined = alive.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")
    common = joined.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return common.where((100 * F.col("i")) >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def hot_size(shared: DataFrame) -> int:
    """Members above which a bucket is hot; of all buckets' members together, no more than ``HOT_BUCKETS`` buckets can have so many."""
    members = shared.agg(F.sum("size")).first()[0] or 0
    return max(HOT, -(-members // HOT_BUCKETS))


def join_buckets(rows: DataFrame, shared: DataFrame, hot: int, on: Sequence[str] = ("key",)) -> DataFrame:
    """Rows with what is known of their bucket (its key, size and more); rows of other buckets go."""
    few, many = shared.where(F.col("size") > hot), shared.where(F.col("size") <= hot)
    cold = rows.join(F.broadcast(few.select(*on)), list(on), "left_anti")
    return rows.join(F.broadcast(few), list(on)).unionByName(cold.join(many, list(on)))


def new_pivots(large: DataFrame, seed: int, hot: int) -> DataFrame:
    """Pairs a < b of one pivot of each bucket and the members that don't hang together with it."""
    order = F.xxhash64("cls", F.lit(seed))  # of buckets with the same members, the same one
    pivots = large.groupBy("key", "size").agg(F.min_by(F.struct("cls", "label"), order).alias("pivot"))
    pairs = join_buckets(large.drop("size"), pivots, hot).where(F.col("label") != F.col("pivot.label"))
    return pairs.select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b")).distinct()


def apart(buckets: DataFrame, labels: DataFrame, hot: int) -> DataFrame:
    """key, size, cls, label of the buckets of three or more whose members don't hang together yet."""
    rows = buckets.where("size > 2").select("key", "size", "cls").join(labels.select(F.col("id").alias("cls"), "label"), "cls", "left")
    rows = rows.select("key", "size", "cls", F.coalesce("label", "cls").alias("label"))
    parted = rows.groupBy("key", "size").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "size")
    return join_buckets(rows.drop("size"), parted, hot).select("key", "size", "cls", "label")


def split_buckets(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """key, cls, label of what is to be compared whole: buckets as they are, and of those above ``BLOCK`` members the buckets of their prefixes."""
    small = rows.where(F.col("size") <= BLOCK).select("key", "cls", "label")
    members = scratch.keep(rows.where(F.col("size") > BLOCK).select("cls", "label").distinct())
    if not members.limit(1).count():
        return small
    held = scratch.keep(members.join(sets, "cls").select("cls", "label", "shingles"))
    counts = scratch.keep(held.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("size")))
    # Of shingles those that more than hot_size sets have, HOT_BUCKETS at most, and how they rank; all others come first.
    frequent = counts.where(F.col("size") > hot_size(counts)).orderBy("size", "key").select("key").collect()
    keys = np.array([r.key for r in frequent], dtype=np.int64)
    by_key = np.argsort(keys)
    shared = members.sparkSession.sparkContext.broadcast((keys[by_key], by_key + 1))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            out = [prefix(x.values.to_numpy(), keys, ranks, percent) for x in batch.column(2)]
            of = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()), batch.column(0).take(of), batch.column(1).take(of)], ["key", "cls", "label"])

    prefixes = scratch.keep(mapped(held, prefixed, "key bigint, cls bigint, label bigint"))
    parted = scratch.keep(prefixes.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size"))
    return small.union(join_buckets(prefixes, parted, hot_size(parted)).select("key", "cls", "label"))


def prefix(shingles: np.ndarray, keys: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, by rank (0 for those that aren't among the sorted keys), then number, of which a similar set has one."""
    at = np.minimum(np.searchsorted(keys, shingles), max(len(keys) - 1, 0))
    rank = np.where(keys[at] == shingles, ranks[at], 0) if len(keys) else np.zeros(len(shingles), np.int64)
    n = len(shingles)
    return shingles[np.lexsort((shingles, rank))][: n + (-n * percent) // 100 + 1]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each of some sets and each of others."""
    sizes = [len(x) for x in (*left, *right)]
    values, where, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    use = counts[where] > 1
    owner = np.repeat(np.arange(len(sizes)), sizes)[use]
    column = shared[where][use]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    step = 4096
    for at in range(0, int(column.max(initial=-1)) + 1, step):
        inside = (column >= at) & (column < at + step)
        bits = np.zeros((len(sizes), step), dtype=bool)
        bits[owner[inside], column[inside] - at] = True
        packed = np.packbits(bits, axis=1).view(U)
        a, b = packed[: len(left)], packed[len(left) :]
        for i in range(len(left)):
            out[i] += np.bitwise_count(b & a[i]).sum(axis=1, dtype=np.int64)
    return out


def joining_links(cls: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows ``first`` and rows ``second`` that join labels which don't hang together by earlier ones."""
    common = common_counts([sets[i] for i in first], [sets[i] for i in second])
    size = np.array([len(x) for x in sets], dtype=np.int64)
    near = 100 * common >= percent * (size[first][:, None] + size[second][None, :] - common)
    near &= labels[first][:, None] != labels[second][None, :]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = top(int(labels[first[i]])), top(int(labels[second[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(cls[first[i]]), int(cls[second[j]])))
    return out


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b that join different labels in a bucket, from comparing all its members in pairs of blocks.

    Members that share several bands or prefixes make several buckets of the same members; one of these is compared.
    """
    sets = of_ids(sets, rows.select("cls").distinct())
    sized = rows.join(sets.select("cls", F.size("shingles").alias("n")), "cls")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    members = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    named = sized.groupBy("key").agg(blocks, F.count("*").alias("size"), *members)
    of = named.groupBy("blocks", "size", "m1", "m2").agg(F.min("key").alias("key")).select("key", "blocks", "size")
    dealt = join_buckets(rows, of, hot_size(of)).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    pairs = dealt.select("key", "cls", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    task = pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "label").join(sets, "cls")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        cls, labels, own = (table.column(c).to_numpy() for c in ("cls", "label", "own"))
        lists = [x.values.to_numpy() for x in table.column("shingles").combine_chunks()] if table.num_rows else []
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = joining_links(cls, labels, lists, first, second, percent) if len(first) and len(second) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return task.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that are kept, one of each component, with their own columns."""
    marked = deduplicate(docs, words, threshold)
    gone = marked.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return of_ids(docs, gone, "left_anti").select(*docs.columns)
