"""Duplicate regions of statements: windows, fingerprints, groups, and what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.operators import regions

# Least tokens of a region, tokens between regions that are merged, and lengths of windows.
MIN_TOKENS, MAX_GAP_TOKENS, MIN_SIMILARITY = 40, 30, 70
LEAST_WINDOW, MOST_WINDOW = 2, 100
LITERAL_PERCENT = 20


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anonymous(said: Column) -> Column:
    """Words of a token list replaced by the place where each first occurs; other tokens stay. Null stays null, an empty list empty. Regions use the quicker form of ``regions``.

    Equal tokens are brought together by sorting, so that the work follows n log n and not the square of a long text's tokens.
    """
    placed = F.sort_array(F.transform(said, lambda t, i: F.struct(t.alias("token"), (i + 1).alias("at"))))

    def renamed(run: Column, first: Column) -> Column:
        name = F.when(first["token"].rlike(r"^[\p{L}_]"), F.concat(F.lit("$"), first["at"].cast("string"))).otherwise(first["token"])
        return bound(name, lambda n: F.transform(run, lambda x: F.struct(x["at"].alias("at"), n.alias("name"))))

    def by_place(rows: Column) -> Column:
        starts = F.transform(rows, lambda x, k: F.when((k == 0) | (F.get(rows, k - 1)["token"] != x["token"]), k))
        ends = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(rows))
        runs = lambda at: F.flatten(F.transform(at, lambda k, j: renamed(F.slice(rows, k + 1, ends(at, j) - k), F.get(rows, k))))
        return bound(F.filter(starts, lambda k: k.isNotNull()), runs)

    return F.transform(F.sort_array(bound(placed, by_place)), lambda x: x["name"])


def windows(files: DataFrame, most: int) -> DataFrame:
    """Every run of 2 to ``most`` statements of a container: file, container, pos, len, key (binary), distinct, first and last line.

    Files without a name have none, as equality joins nothing to them.
    """
    return regions.each_file(files.where("file is not null"), regions.window_rows(most), "container bigint, pos int, len int, key binary, distinct_lines int, first_line int, last_line int")


def repeating(files: DataFrame, most: int) -> DataFrame:
    """Keys of windows that occur at least twice without only overlapping themselves, with at least two distinct lines: key, occurrences, files.

    A file sends one row for each key, so keys are brought together once, and files are counted and not compared.
    """
    each = regions.each_file(files.where("file is not null"), regions.window_key_rows(most), "key binary, n bigint, low int, high int, len int, containers boolean")
    apart = (F.max("high") - F.min("low") >= F.max("len")) | (F.count("*") > 1) | F.max("containers")
    kept = each.groupBy("key").agg(F.sum("n").alias("occurrences"), F.count("file").alias("files"), apart.alias("apart"))
    return kept.where("occurrences > 1 and apart").drop("apart")


def maximal(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Repeating windows that no repeating window longer by one statement, before or behind, holds."""
    hot = found.join(kept, "key")
    longer = hot.select("file", "container", F.col("pos").alias("p"), F.col("len").alias("n"))
    at = [F.col("w.file") == F.col("l.file"), F.col("w.container") == F.col("l.container"), F.col("l.n") == F.col("w.len") + 1]
    alone = hot.alias("w").join(longer.alias("l"), [*at, F.col("l.p") == F.col("w.pos")], "left_anti")
    return alone.alias("w").join(longer.alias("l"), [*at, F.col("l.p") == F.col("w.pos") - 1], "left_anti")


def blocks(files: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """Containers of at least ``least`` tokens: file, container, n_tokens, key, first and last line."""
    return regions.each_file(files, regions.block_rows(least), "container bigint, n_tokens int, key string, first_line int, last_line int")


def cross_file(candidates: DataFrame) -> DataFrame:
    """Candidates whose key occurs in at least two files. They are made once."""
    same = Window.partitionBy("key")
    return candidates.withColumns({"a": F.min("file").over(same), "b": F.max("file").over(same)}).where("a < b").drop("a", "b")


def covered_lines(found: DataFrame) -> DataFrame:
    """file, line_no of all lines of the regions found, each once."""
    return found.select("file", F.explode(F.sequence("first_line", "last_line")).alias("line_no")).distinct()


def partners(found: DataFrame) -> DataFrame:
    """file, partners: the other files that share a key. Files are first made distinct for each key."""
    each = found.select("key", "file").distinct()
    return each.alias("a").join(each.alias("b"), "key").where(F.col("a.file") != F.col("b.file")).groupBy(F.col("a.file").alias("file")).agg(F.array_sort(F.collect_set("b.file")).alias("partners"))
