"""Numbers made from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values whose ranks may be broadcast.
BROADCAST_VALUES = 100_000


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """vocabulary, length, volume and effort from distinct and total operators and operands; 0 where nothing is counted."""
    vocabulary, length = n1 + n2, total1 + total2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(F.lit(0.0))
    effort = F.when(n2 > 0, (n1 / F.lit(2.0)) * (total2 / n2) * volume).otherwise(F.lit(0.0))
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "effort": effort}


def with_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """The share of rows whose value is strictly smaller, in [0, 1).

    Ranks come from the counts of the distinct values, so the one ordered window runs over these and
    not over all rows.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.select("_v", ((upto - F.col("_n")) / F.sum("_n").over(Window.partitionBy())).alias(name))
    return df.join(ranks, df[value].eqNullSafe(ranks["_v"])).drop("_v")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def clamp_u32(value: Column) -> Column:
    """A number cut to [0, 2**32 - 1], its fraction dropped; NaN is null, for a default to take its place."""
    return F.when(~F.isnan(value), F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(2**32 - 1))).cast("bigint")
