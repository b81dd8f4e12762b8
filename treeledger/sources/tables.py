"""Parquet tables as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files_from(rows: DataFrame, file: str, code: str, language: str | None = None) -> DataFrame:
    """file, language, code: a table of texts as source files."""
    return rows.select(F.col(file).alias("file"), (F.col(language) if language else F.lit("text")).alias("language"), F.col(code).alias("code"))
