"""Cutting payloads into chunks, and statistics of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 524_288


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    return F.ceil(size / chunk).cast("int")


def chunked(df: DataFrame, id_col: str, payload: str, chunk: int = CHUNK, *carried: str) -> DataFrame:
    """(id, chunk_idx, data, carried columns): the payload cut every ``chunk`` bytes, the last piece shorter; an empty
    or null payload has no chunk.  Cutting is an expression, so nothing is shuffled."""
    n = chunk_count(F.octet_length(payload), chunk)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    rows = df.select(F.col(id_col), F.col(payload).alias("__p"), *carried, F.explode(starts).alias("chunk_idx"))
    return rows.select(id_col, "chunk_idx", F.expr(f"substring(__p, chunk_idx * {chunk} + 1, {chunk})").alias("data"), *carried)


def _counted(df: DataFrame, payload: str, by: tuple[str, ...], order: int) -> DataFrame:
    """``by``, code and n: how often each run of ``order`` bytes, read as a big-endian number, occurs.

    Batches are counted in numpy where they lie, so a task sends 256 or 65,536 numbers for each of its groups and
    batches, whatever the bytes."""
    size = 256**order

    def run(batches: Iterator[pa.RecordBatch]):
        whole = np.zeros(size, np.int64)
        for batch in batches:
            for cut in _slices(batch):
                content = cut.column(0).fill_null(b"")
                starts = np.frombuffer(content.buffers()[1], np.int64 if pa.types.is_large_binary(content.type) else np.int32)
                starts = starts[content.offset : content.offset + len(content) + 1].astype(np.int64)
                data = np.frombuffer(content.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
                codes = data[order - 1 :].astype(np.int64)
                if order == 2:
                    codes += data[:-1].astype(np.int64) << 8
                    inside = np.ones(len(codes), bool)
                    ends = (starts[1:-1] - starts[0] - 1)[starts[1:-1] < starts[-1]]
                    inside[ends[ends >= 0]] = False  # no pair of the last byte of a value and the first of the next
                if not by:
                    whole += np.bincount(codes[inside] if order == 2 else codes, minlength=size)
                    continue
                groups: dict[tuple, int] = {}
                own = [groups.setdefault(g, len(groups)) for g in zip(*(c.to_pylist() for c in cut.columns[1:]))]
                first = pa.array(np.unique(own, return_index=True)[1])
                rows = np.repeat(np.array(own, np.int64), np.diff(starts))[order - 1 :]
                if order == 2:
                    codes, rows = codes[inside], rows[inside]
                both, times = np.unique(rows * size + codes, return_counts=True)
                keys = [c.take(first.take(pa.array(both // size))) for c in cut.columns[1:]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((both % size).astype(np.int32)), pa.array(times)], names=[*by, "code", "n"])
        if not by:
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[at])], names=["code", "n"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    parts = df.select(payload, *by).mapInArrow(run, f"{kinds}code int, n long")
    return parts.groupBy(*by, "code").agg(F.sum("n").alias("n"))


def _slices(batch: pa.RecordBatch, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows of about ``most`` bytes of the first column, a longer one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def byte_histogram(df: DataFrame, payload: str, *by: str) -> DataFrame:
    """How often each byte value occurs, in all or for each group; counted before the shuffle."""
    return _counted(df, payload, by, 1).withColumnRenamed("code", "byte")


def context_counts(df: DataFrame, payload: str) -> DataFrame:
    """Order-1 statistics: how often ``byte`` follows ``prev`` within a payload, and the count of smaller
    bytes after the same ``prev`` (the range an arithmetic coder would use)."""
    counts = _counted(df, payload, (), 2).select(F.shiftright("code", 8).alias("prev"), F.col("code").bitwiseAND(F.lit(255)).alias("byte"), "n")
    before = Window.partitionBy("prev").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
