"""Helpers shared by the operators: reading tables and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How the folders of written tables begin.
PREFIX = "treeledger-"
#: Bytes of a batch that goes to a Python worker, and of a part whose values it makes Python objects of at once; a single row may be larger.
BATCH_BYTES = 1 << 20
MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session that runs in one JVM may fall back to a temporary folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="treeledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def least_hashes(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """The rows of the smallest hashes of a column, ``rows`` of ``total`` at most.

    Most rows are left out by a bound on the hash before any are ordered, so that what tasks send on to be ordered
    doesn't grow with their number.
    """
    hashed = F.xxhash64(column)
    if total > 4 * rows:
        df = df.where(hashed < -(2**63) + int(2**64 * (2 * rows / total)))
    return df.orderBy(hashed, column).limit(rows)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of batches, in slices of ``BATCH_BYTES`` or of one row."""
    for batch in batches:
        if batch.nbytes <= BATCH_BYTES or batch.num_rows < 2:
            yield batch
            continue
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1])
            else:
                sizes += -(-column.nbytes // batch.num_rows)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in small parts, so that the memory of an executor and of its workers doesn't grow with the rows of a batch.

    The session's limit for the bytes of a batch is lowered to ``BATCH_BYTES``, as the executor holds each batch too.
    """
    spark = df.sparkSession
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < bytes_of(str(spark.conf.get(MOST_BYTES))) <= BATCH_BYTES:
        spark.conf.set(MOST_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: run(parts(batches)), schema)


class Scratch:
    """Written tables of one query. Each is a cut in the lineage that survives lost executors.

    ``keep`` writes a frame as Parquet and reads it back; ``drop`` removes a table that no
    later frame reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._scratch_path)

    def drop_but(self, frame: DataFrame) -> None:
        """Removes all tables but one."""
        for i in range(1, self.n + 1):
            if (path := f"{self.root}/{i}") != frame._scratch_path:
                self._delete(path)

    def drop_all(self) -> None:
        """Removes all tables, when nothing reads them any more."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Removes what this application's queries have left in the shared folder; results that still read it can't be read any more."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern) or []:
        files.delete(status.getPath(), True)
