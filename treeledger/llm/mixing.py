"""Mixing sources to target weights by a temperature, as budgeted block permutations.

A source's weight is its share of all words to the power of an exponent in [0, 1]: 1 keeps the
shares, 0 makes all sources alike. The exponent is found by bisection, inside one expression, as
the smallest one by which no source is passed more than ``most_epochs`` times and, if a target
entropy is given, the entropy of the weights is not above it. The budget is the least by which the largest source,
and so every document, is passed once.

Weights are then realised. A source with a budget of 1.6 epochs is passed once in full and once in
part. Each pass is a permutation of its documents by a hash of doc_id and pass; of the last
pass those are taken whose running sum of words stays within the budget. A copy's running sum, as a part of its
source's budget, places it in one of the blocks of the mix, so each block holds the sources in
their target weights; in a block copies are permuted by their hash.

Running sums are made in two steps, over hash buckets of bounded length and over the buckets' sums,
so a hot source is spread. All is DataFrame expressions. The plan has one row for each source; it is
broadcast only if it has few rows.

A source without any words has no place by words; its documents are dealt to the blocks by their hash. There is a block for
each ``BLOCK_WORDS`` words or ``BLOCK_DOCS`` documents, whichever gives more.

Defined cases: a null source is a source of its own; null texts and texts without words count 0
words, and belong to every full pass; a source without any words is passed once; documents of one
doc_id have one place in a permutation and are taken or left together; an empty table gives an
empty table; other columns are ignored, or kept by ``mix_documents``, whatever their names; equal hashes are ordered by doc_id,
source and words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch

MOST_EPOCHS, BLOCK_WORDS, BLOCK_DOCS, STEPS = 2.0, 1_000_000, 200_000, 50
#: Documents in a hash bucket, about, and sources of which the plan is broadcast.
BUCKET, BROADCAST_SOURCES = 2048, 10_000
MICRO = 1_000_000
#: Steps of the exponents at which entropies are made.
GRID = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A key that tells the null source from all others."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def hash60(doc_id: Column, epoch: Column) -> Column:
    """60 bits that place a document in the permutation of a pass."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("-"), epoch.cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("bigint")


def exponent(ends: Column, most_epochs: float, entropy_fits: Column | None = None) -> Column:
    """The exponent for the least and the largest number of words of the sources (low, high), both above 0.

    With a target entropy, ``entropy_fits`` tells for each of ``GRID`` exponents in order whether it meets the target.
    """

    def fits(a: Column) -> Column:
        few = F.pow(ends["low"] / ends["high"], a - 1) <= most_epochs
        return few if entropy_fits is None else few & F.element_at(entropy_fits, F.floor(a * GRID).cast("int") + 1)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(fits(mid), s["lo"]).otherwise(mid).alias("lo"), F.when(fits(mid), mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)["hi"]
    return F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(F.ceil(found * MICRO) / MICRO)


def entropy_table(each: DataFrame, target: float) -> Column:
    """For each exponent of the grid whether the entropy of the weights is at most the target. Sums go over all sources."""
    top = each.select(F.max("sum")).scalar()
    grid = each.where("sum > 0").select((F.col("sum") / top).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("i"))
    a = F.col("i") / GRID
    sums = grid.groupBy("i").agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("y"))
    entropy = F.log("z") - F.col("i") / GRID * F.col("y") / F.col("z")
    return sums.select(F.transform(F.sort_array(F.collect_list(F.struct("i", (entropy <= target).alias("fits")))), lambda x: x["fits"])).scalar()


def plan_sources(rows: DataFrame, most_epochs: float = MOST_EPOCHS, target_entropy: float | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: key, sum, budget, full, rest, buckets, weight, blocks; from rows of key and words.

    What is made of all sources is one row of sums, that goes to each; sources themselves are never brought together.
    """
    each = rows.groupBy("key").agg(F.sum("words").alias("sum"), F.count("*").alias("docs"))
    positive = F.when(F.col("sum") > 0, F.col("sum").cast("double"))
    ends = each.agg(F.min(positive).alias("low"), F.max(positive).alias("high"), F.sum("docs").alias("all_docs"))
    fits = None if target_entropy is None else F.col("entropy_fits")
    if target_entropy is not None:
        ends = ends.withColumn("entropy_fits", entropy_table(each, target_entropy))
    one = ends.select(F.struct(F.col("high").alias("top"), "all_docs", F.when(F.col("high") > 0, exponent(F.struct("low", "high"), most_epochs, fits)).alias("exponent")))
    part = each.withColumn("one", one.scalar()).select("*", "one.*").drop("one")
    micro = F.when(F.col("sum") > 0, F.round(F.pow(F.col("sum") / F.col("top"), F.col("exponent") - 1) * MICRO)).otherwise(F.lit(MICRO)).cast("bigint")
    part = part.withColumn("micro", micro)
    # In two steps, so that the product stays within 64 bits.
    budget = F.floor(F.col("micro") / MICRO) * F.col("sum") + F.floor((F.col("micro") % MICRO) * F.col("sum") / MICRO)
    sized = part.withColumn("budget", budget.cast("bigint")).withColumn("full", F.floor(F.col("micro") / MICRO).cast("int"))
    return sized.withColumn("total", sized.select(F.sum("budget")).scalar()).select(
        "key",
        "sum",
        "budget",
        "full",
        (F.col("budget") - F.col("full") * F.col("sum")).alias("rest"),
        F.pow(F.lit(2.0), F.least(F.lit(24.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("docs") / BUCKET))))).cast("bigint").alias("buckets"),
        F.when(F.col("total") > 0, F.try_divide("budget", "total")).otherwise(F.lit(0.0)).alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / block_words), F.ceil(F.col("all_docs") / BLOCK_DOCS)).cast("bigint").alias("blocks"),
    )


def with_plan(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    few = plan.count() <= BROADCAST_SOURCES
    part = plan.select(F.col("key").alias("_key"), *columns)
    return rows.join(F.broadcast(part) if few else part, F.col("key") == F.col("_key")).drop("_key")


def place_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The copies of rows (doc_id, source, key, words) that are taken, with h, epoch, run (the source's words before it) and the plan's columns."""
    passes = F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1))
    copies = with_plan(rows, plan, ["sum", "budget", "full", "rest", "buckets", "blocks"]).withColumn("epoch", F.explode(passes))
    copies = copies.withColumn("h", hash60(F.col("doc_id"), F.col("epoch"))).withColumn("bucket", F.floor(F.col("h") / (F.lit(2**60) / F.col("buckets"))).cast("bigint"))
    at = ["key", "epoch", "bucket"]
    sums = copies.groupBy(at).agg(F.sum("words").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(Window.partitionBy("key", "epoch").orderBy("bucket")) - F.col("own")).drop("own")
    inside = copies.withColumn("upto", F.sum("words").over(Window.partitionBy(at).orderBy("h").rangeBetween(Window.unboundedPreceding, 0)))
    run = inside.join(before, at).withColumn("upto", F.col("upto") + F.col("before"))
    taken = run.where((F.col("epoch") < F.col("full")) | (F.col("upto") <= F.col("rest")))
    return taken.withColumn("run", F.col("epoch") * F.col("sum") + F.col("upto") - F.col("words"))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("words"))


def mix(docs: DataFrame, most_epochs: float = MOST_EPOCHS, target_entropy: float | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per copy: doc_id, source, words, epoch, block, place (from 1, in the block)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(rows_of(docs))
    plan = scratch.keep(plan_sources(rows, most_epochs, target_entropy, block_words))
    block = F.when(F.col("budget") > 0, F.least(F.floor(F.col("run") / F.col("budget").cast("double") * F.col("blocks")), F.col("blocks") - 1)).otherwise(F.pmod("h", "blocks"))
    placed = place_copies(rows, plan).withColumn("block", block.cast("bigint"))
    order = Window.partitionBy("block").orderBy("h", "doc_id", "key", "words")
    return placed.select("doc_id", "source", "words", F.col("epoch").cast("int").alias("epoch"), "block", F.row_number().over(order).alias("place"))


def mix_documents(docs: DataFrame, most_epochs: float = MOST_EPOCHS, target_entropy: float | None = None) -> DataFrame:
    """The documents, each as often as it is taken, with their own columns. Texts are not shuffled."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(rows_of(docs))
    plan = scratch.keep(plan_sources(rows, most_epochs, target_entropy))
    last = place_copies(rows, plan).where(F.col("epoch") == F.col("full")).groupBy("key").agg(F.max("h").alias("upto_h"))
    rule = scratch.keep(plan.join(last, "key", "left").select("key", F.col("full").alias("_full"), F.coalesce("upto_h", F.lit(-1)).alias("_upto")))
    # The document travels as one column, so that no name of its own can clash.
    keyed = docs.select(F.struct("*").alias("doc")).withColumn("key", source_key(F.col("doc.source")))
    ruled = with_plan(keyed, rule, ["_full", "_upto"])
    times = F.col("_full") + F.when(hash60(F.col("doc.doc_id"), F.col("_full")) <= F.col("_upto"), 1).otherwise(0)
    return ruled.select("doc", F.explode(F.sequence(F.lit(1), times))).select("doc.*")
