"""Per-file measures over a folder that files land in; an extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeledger.plans import measure

LANDED = "file string, language string, code string, landed timestamp"


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files of file, language, code, landed."""
    return spark.readStream.schema(LANDED).parquet(folder)


def measure_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the measures of each batch of files to a Parquet folder."""

    def each(batch: DataFrame, number: int) -> None:
        measure.file_metrics(measure.parse(batch)).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lines_per_hour(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """language, window, files, lines: landed files by the hour; what is later than ``late`` is left out."""
    lines = F.size(F.split(F.coalesce("code", F.lit("")), "\r\n|\n|\r", -1))
    return files.withWatermark("landed", late).groupBy(F.window("landed", "1 hour"), "language").agg(F.count("*").alias("files"), F.sum(lines).alias("lines"))
