"""Similarity of token sequences: shared n-grams, multiset overlap, common subsequences, components, matching."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from treeledger.functions.text import well_formed
from treeledger.plans.session import checkpoint_dir

NGRAM = 5


#: Grams that are sent to all tasks, so that only those leave the texts; where there are more, all are joined.
MOST_GRAMS = 200_000
WORDS = re.compile(r"\w+")


def ngrams(text: str, n: int = NGRAM) -> set[str]:
    """Distinct runs of n words of a lower-case text, joined by spaces."""
    words = WORDS.findall(text)
    return set(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def gram_rows(texts: DataFrame, among: Broadcast | None = None) -> DataFrame:
    """id, gram of the n-grams of texts (id, text), of those ``among`` only where that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [ngrams(t) if among is None else ngrams(t) & among.value for t in part.column(1).to_pylist()]
                rows = [i for i, grams in enumerate(found) for _ in grams]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array([g for grams in found for g in grams], pa.string())], ["id", "gram"])

    lower = texts.where("text is not null").select("id", F.lower(well_formed(F.col("text"))).alias("text"))
    return lower.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, gram string")


def shared_ngrams(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, shared: numbers of common n-grams of texts (id, text). The join follows the grams, not the pairs."""
    spark = left.sparkSession
    few = [r.gram for r in gram_rows(left).select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    among = spark.sparkContext.broadcast(frozenset(few)) if len(few) <= MOST_GRAMS else None
    both = gram_rows(left).withColumnRenamed("id", "a").join(gram_rows(right, among).withColumnRenamed("id", "b"), "gram")
    return both.groupBy("a", "b").agg(F.count_distinct("gram").alias("shared"))


#: Ids that are sent to all tasks to choose texts by.
MOST_IDS = 1_000_000


def overlap(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, overlap: sizes of the multiset intersections of pairs, from texts (id, said: their tokens).

    Pairs are made once; texts without a pair are left out before their tokens become rows.
    """
    spark = pairs.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    pairs = pairs.checkpoint()

    def counts(rows: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col(name).alias("id")).distinct()
        ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
        met = rows.join(ids, "id", "left_semi").select("id", F.explode("said").alias("token"))
        return met.groupBy(F.col("id").alias(name), "token").agg(F.count("*").alias(f"n_{name}"))

    met = pairs.join(counts(left, "a"), "a").join(counts(right, "b"), ["b", "token"])
    return met.groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("overlap"))


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, with one big integer as the row of the table."""
    if not len(a) or not len(b):
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * common subsequence / longer length, rounded down; 0 for two empty sequences."""
    return pd.Series([100 * lcs_length(x, y) // max(len(x), len(y)) if len(x) or len(y) else 0 for x, y in zip(a, b, strict=True)])


def similar_pairs(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """a, b, percent of pairs at least so similar, from rows of id, bucket and sequence. Lengths are compared before sequences."""
    n = lambda c: F.size(c)
    pairs = left.toDF("a", "bucket", "sa").join(right.toDF("b", "bucket", "sb"), "bucket")
    near = pairs.where((F.least(n("sa"), n("sb")) * 100 >= F.greatest(n("sa"), n("sb")) * least) & (F.greatest(n("sa"), n("sb")) > 0))
    return near.select("a", "b", lcs_percent("sa", "sb").alias("percent")).where(F.col("percent") >= least)


def best_matching(rows: Sequence[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """A largest one-to-one matching of pairs (a, b, percent): best first, then augmented; pairs of 100 stay."""
    mate_a: dict[str, str] = {}
    mate_b: dict[str, str] = {}
    locked: set[str] = set()
    for a, b, percent in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in mate_a and b not in mate_b:
            mate_a[a], mate_b[b] = b, a
            if percent == 100:
                locked.add(b)
    options: dict[str, list[str]] = {}
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        options.setdefault(a, []).append(b)

    def augment(a: str, seen: set[str]) -> bool:
        for b in options[a]:
            if b in seen or b in locked:
                continue
            seen.add(b)
            if b not in mate_b or augment(mate_b[b], seen):
                mate_a[a], mate_b[b] = b, a
                return True
        return False

    for a in sorted(options):
        if a not in mate_a:
            augment(a, set())
    return sorted(mate_a.items())


def match_groups(pairs: DataFrame) -> DataFrame:
    """bucket, a, b: the matching of each bucket, from bucket, a, b, percent."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        got = best_matching([(str(r.a), str(r.b), int(r.percent)) for r in frame.itertuples()])
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]] * len(got), "a": [a for a, _ in got], "b": [b for _, b in got]})

    kind = pairs.schema["bucket"].dataType.simpleString()
    return pairs.groupBy("bucket").applyInPandas(one, f"bucket {kind}, a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of each id's component, from edges a, b. Rounds go on until no root changes; each is cut off with a reliable checkpoint.

    Edges with a null end link nothing and name nothing; an edge from an id to itself names it; no edges give no rows.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    edges = edges.where("a is not null and b is not null")
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")).checkpoint()
    while True:
        near = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("near"))
        via = roots.join(near, roots.id == near.a).select("id", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        jump = roots.select(F.col("id").alias("via"), F.col("root").alias("jump"))
        new = via.join(jump, "via", "left").select("id", "old", F.least("via", F.coalesce("jump", "via")).alias("root")).checkpoint()
        roots = new.select("id", "root")
        if not new.where("old <> root").limit(1).count():
            return roots
