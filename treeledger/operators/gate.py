"""The regression gate: a change set held against its base revision; only violations come out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NewLimits:
    """Limits of a function that has no counterpart in the base."""

    cognitive: int = 15
    ncss: int = 60
    nesting: int = 4


@dataclass(frozen=True)
class Tolerance:
    """How much a matched function or file may worsen."""

    cognitive: int = 2
    ncss: int = 5
    nesting: int = 1
    dep_degree: int = 10
    volume: float = 150.0
    file_ncss: int = 20
    duplicate_lines: int = 0


@dataclass(frozen=True)
class GateOptions:
    limits: NewLimits = field(default_factory=NewLimits)
    tolerance: Tolerance = field(default_factory=Tolerance)
    similarity_percent: int = 70
    split_percent: int = 30
    most_comparisons: int = 10_000


#: The share of its base value by which a Halstead volume may grow, if that is more than the tolerance.
VOLUME_SHARE = 0.25


def match_by_key(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (base_id, head_id) of functions that are alone with their keys on both sides. A null key matches nothing."""

    def alone(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    return alone(base, "base_id").join(alone(head, "head_id"), keys).select("base_id", "head_id")


def match_rounds(base: DataFrame, head: DataFrame) -> DataFrame:
    """Matches on file, name and arity, then on file and name of what is left."""
    first = match_by_key(base, head, ["file", "name", "arity"])
    rest_base = base.join(first, base.id == first.base_id, "left_anti")
    rest_head = head.join(first, head.id == first.head_id, "left_anti")
    return first.unionByName(match_by_key(rest_base, rest_head, ["file", "name"]))


def unmatched(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return rows.join(matches, rows.id == matches[side], "left_anti")


def ratchets(tolerance: Tolerance = Tolerance()) -> list[tuple[str, str, Column]]:
    """(metric, column, allowance) of what a matched function may not worsen; allowances read base_<column>."""
    flat = lambda x: F.lit(float(x))
    return [
        ("cognitive complexity", "cognitive", flat(tolerance.cognitive)),
        ("NCSS", "ncss", flat(tolerance.ncss)),
        ("max nesting depth", "nesting", flat(tolerance.nesting)),
        ("DepDegree", "dep_degree", flat(tolerance.dep_degree)),
        ("Halstead volume", "volume", F.greatest(flat(tolerance.volume), F.col("base_volume") * VOLUME_SHARE)),
    ]


def ratchet_violations(pairs: DataFrame, checks: list[tuple[str, str, Column]], keys: list[str]) -> DataFrame:
    """keys, metric, base_value, head_value, allowed of pairs whose head exceeds base plus allowance."""
    each = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"base_{c}").cast("double").alias("base_value"), F.col(f"head_{c}").cast("double").alias("head_value"), (F.col(f"base_{c}") + a).cast("double").alias("allowed")) for m, c, a in checks])
    )
    return pairs.select(*keys, each.alias("v")).select(*keys, "v.*").where("head_value > allowed")


def limit_violations(rows: DataFrame, limits: list[tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """keys, metric, head_value, allowed of new rows beyond a limit."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("head_value"), F.lit(float(x)).alias("allowed")) for m, c, x in limits]))
    return rows.select(*keys, each.alias("v")).select(*keys, "v.*").where("head_value > allowed")


def file_backstops(files: DataFrame, reported: DataFrame, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """file, metric, base_value, head_value, allowed for files with split evidence.

    ``files`` has file, split and base_ and head_ max_cognitive and ncss; ``reported`` has file and head_value of
    cognitive violations, of which one at the file's maximum silences the first check.
    """
    armed = files.where(F.col("split") & F.col("base_ncss").isNotNull() & F.col("head_ncss").isNotNull())
    rows = armed.select(
        "file",
        F.explode(
            F.array(
                F.struct(F.lit("file max cognitive complexity").alias("metric"), F.col("base_max_cognitive").cast("double").alias("base_value"), F.col("head_max_cognitive").cast("double").alias("head_value"), (F.col("base_max_cognitive") + tolerance.cognitive).cast("double").alias("allowed")),
                F.struct(F.lit("file NCSS").alias("metric"), F.col("base_ncss").cast("double").alias("base_value"), F.col("head_ncss").cast("double").alias("head_value"), (F.col("base_ncss") + tolerance.file_ncss).cast("double").alias("allowed")),
            )
        ).alias("v"),
    ).select("file", "v.*")
    over = rows.where("head_value > allowed")
    said = reported.select("file", F.col("head_value").cast("double").alias("head_value"), F.lit("file max cognitive complexity").alias("metric"))
    return over.join(said, ["file", "metric", "head_value"], "left_anti").select("file", "metric", "base_value", "head_value", "allowed")


def swap_universe(head: DataFrame, changed: DataFrame, base: DataFrame) -> DataFrame:
    """The base revision's files: the head's with changed ones taken out and their base texts put in."""
    return head.join(changed, "file", "left_anti").unionByName(base)
