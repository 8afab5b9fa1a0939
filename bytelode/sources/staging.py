"""Staging tables of batch runs: what a run has written, a later one reads and goes on from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.  Where it is unset, one in the warehouse, which
    they share as well; with local threads, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        threads = spark.sparkContext.master.split("[")[0] == "local"
        path = tempfile.mkdtemp(prefix="spark-") if threads else f"{spark.conf.get('spark.sql.warehouse.dir')}/shared-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Spark's limit for what it hands to Python at once, which is as good as none by default, and that of staging tables.
LIMIT, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets Arrow batches of about ``MOST_BYTES`` in jobs that run within, a longer row alone, so that workers' memory follows
    neither the table nor the size of its rows."""
    old = spark.conf.get(LIMIT)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old) <= MOST_BYTES:
        yield
        return
    spark.conf.set(LIMIT, str(MOST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(LIMIT, old)


class Staging:
    """A table of parts under ``path``, which all executors share.  Every save is a part of its own, written
    aside by Spark and named when it is complete, so a run that breaks off leaves whole parts only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def beside(cls, spark: SparkSession, name: str) -> Staging:
        """A new one in the shared folder."""
        return cls(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")

    def _parts(self) -> list[str]:
        if not self._fs.exists(self._at):
            return []
        parts = [p.getPath() for p in self._fs.listStatus(self._at)]
        done = (self._fs.exists(self._jpath(p.toString(), "_SUCCESS")) for p in parts)
        return sorted(p.toString() for p, whole in zip(parts, done) if whole)

    def _jpath(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(names))

    def exists(self) -> bool:
        return bool(self._parts())

    def save(self, rows: DataFrame) -> None:
        with small_batches(self.spark):
            rows.write.parquet(f"{self.path}/part={uuid.uuid4().hex}")

    def load(self) -> DataFrame:
        """All complete parts; raises if there are none, see ``exists``."""
        return self.spark.read.parquet(*self._parts())

    def remove(self) -> None:
        self._fs.delete(self._at, True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, computed once: written to the shared folder and read back."""
    staging = Staging.beside(rows.sparkSession, name)
    staging.save(rows)
    return staging.load()
