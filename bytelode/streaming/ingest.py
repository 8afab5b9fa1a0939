"""Structured Streaming: files that arrive are cut, compressed and appended to a chunk table.

The checkpoint remembers which files are done, and a batch that is written again replaces its own folder, so
a restart neither loses nor doubles a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunks import CHUNK, chunked
from ..operators.compression import compressed


def compress_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, method: str = "huffman", chunk: int = CHUNK) -> StreamingQuery:
    """Take what lies in ``folder`` now and end; call again, or with a trigger of your own, for more."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        made = compressed(chunked(rows, "path", "content", chunk), method).drop("data")
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
