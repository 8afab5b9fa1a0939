"""Resuming a compression run: chunks that are already staged under the same options are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(**options) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(options.items()))


def pending(chunks: DataFrame, staged: DataFrame, key: str, options: str) -> DataFrame:
    """Chunks (key, chunk_idx, data) without a staged row of the same content, place and options.

    A chunk whose bytes have changed since is not skipped: its checksum is part of the match."""
    done = staged.where(F.col("options") == options).select(key, "chunk_idx", F.col("crc32").alias("__crc"))
    rows = chunks.withColumn("__crc", F.crc32("data"))
    return rows.join(done, [key, "chunk_idx", "__crc"], "left_anti").drop("__crc")
