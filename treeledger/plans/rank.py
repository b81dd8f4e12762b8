"""Ranking of source files by relative need of refactoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.measures import ratio, with_percentile
from treeledger.operators import clones
from treeledger.plans import measure


def rank_files(files: DataFrame, top: int = 10, min_tokens: int = clones.MIN_TOKENS) -> DataFrame:
    """The top files by the sum of three percentiles: worst function, duplicated lines, statements; with partners for these only."""
    parsed = measure.parse(files)
    metrics = measure.file_metrics(parsed)
    fns = measure.functions(parsed)
    worst = fns.groupBy("file").agg(F.max_by(F.struct(F.coalesce("name", F.lit("<anonymous>")).alias("name"), "start_line", "end_line", "cognitive", "ncss", "nesting"), F.struct("cognitive", "ncss", -F.col("node"))).alias("worst_function"))
    regions = clones.cross_file(clones.blocks(files.withColumn("file", F.col("file").cast("string")), min_tokens))
    dup = clones.covered_lines(regions).groupBy("file").agg(F.count("*").alias("duplicated"))
    rows = metrics.join(worst, "file", "left").join(dup, "file", "left").withColumn("duplicated", F.coalesce("duplicated", F.lit(0)))
    rows = rows.withColumn("cog", F.coalesce("worst_function.cognitive", F.lit(0)))
    for c in ("cog", "duplicated", "ncss"):
        rows = with_percentile(rows, c, f"p_{c}")
    scored = rows.select("file", "worst_function", "duplicated", ratio(F.col("duplicated"), F.col("code")).alias("duplicated_ratio"), "ncss", "code", (F.col("p_cog") + F.col("p_duplicated") + F.col("p_ncss")).alias("score"))
    best = scored.orderBy(F.desc("score"), F.desc("ncss"), F.collate("file", "UNICODE")).limit(top)
    return best.join(clones.partners(regions), "file", "left").orderBy(F.desc("score"), F.desc("ncss"), F.collate("file", "UNICODE"))
