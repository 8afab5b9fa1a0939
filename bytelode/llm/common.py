"""Helpers shared by the corpus operators: tables, staging and UTF-8 tokens."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder

#: White space of the word contract ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt out to all cores if it has fewer splits than there are cores; larger
    tables stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, a lost
    executor costs nothing that lies before, and row numbers taken by tasks stay as written.  Dictionaries
    of columns, which are mostly hashes and texts, would take longer than all else."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a ``staged`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of jobs that nothing refers to any more: its cleaner goes by the driver's garbage
    collection, which a driver with little to do puts off while executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of each row in __row, as a written table: numbers taken anew by another job
    could differ."""
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def crc_mod5(doc_id: Column | str) -> Column:
    """crc32 of the document's number as text, modulo 5: the folds of the learned operators."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(-1))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8: bytes.lower and bytes.split know
    exactly the ASCII letters and the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, of columns of fixed width, marked for broadcast if it has at most ``most_rows`` rows, else as it is: then
    Spark shuffles.  ``df`` should be cheap to read again (a written table)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
