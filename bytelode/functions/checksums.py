"""CRC-32 and CRC-16, of single values and of chunks put together."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

POLY32, POLY16 = 0xEDB88320, 0x8005


def crc16_table() -> list[int]:
    """Remainders of every byte, most significant bit first."""
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ POLY16 if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


_TABLE16 = crc16_table()


def crc16_of(data: bytes) -> int:
    r = 0
    for b in data:
        r = (r << 8) & 0xFFFF ^ _TABLE16[r >> 8 ^ b]
    return r


#: The remainders repeat after so many zero bytes.
CYCLE16 = 32_767


@functools.cache
def _shifted16() -> np.ndarray:
    """Remainder of every byte with k zero bytes behind it, k up to the cycle."""
    table = np.array(_TABLE16, np.uint16)
    out = np.empty((CYCLE16, 256), np.uint16)
    out[0] = table
    for k in range(1, CYCLE16):
        out[k] = out[k - 1] << np.uint16(8) ^ table[out[k - 1] >> np.uint16(8)]
    return out


def crc16_of_all(values: list[bytes], part: int = 1 << 17) -> np.ndarray:
    """CRC-16 of each value: the sum without carry of its bytes' remainders, each shifted by the bytes behind it; ``part`` bytes are
    worked on at once."""
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    out = np.zeros(len(values), np.int64)
    for lo in range(0, len(data), part):
        at = np.arange(lo, min(lo + part, len(data)))
        of = np.searchsorted(ends, at, "right")
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[heads]] ^= np.bitwise_xor.reduceat(_shifted16()[(ends[of] - at - 1) % CYCLE16, data[at]], heads)
    return out


@arrow_udf(T.LongType())
def crc16(content: pa.Array) -> pa.Array:
    out = []
    for lo in range(0, len(content), 256):
        values = content[lo : lo + 256].to_pylist()
        known = iter(crc16_of_all([v for v in values if v is not None]).tolist())
        out.append(pa.array([None if v is None else next(known) for v in values], pa.int64()))
    return pa.concat_arrays(out) if out else pa.array([], pa.int64())


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 one, coefficients reflected."""
    out, zero, poly = np.zeros(np.broadcast(a, b).shape, np.uint32), np.uint32(0), np.uint32(POLY32)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, zero)
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), poly, zero)
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What CRC-32s become when ``n`` zero bytes follow each: times x to the power 8n."""
    crc, n, square = np.asarray(crc, np.uint32), np.asarray(n, np.int64), np.array([0x00800000], np.uint32)  # x^8
    while n.any():
        crc = np.where(n & 1, _times(crc, square), crc)
        square = _times(square, square)
        n = n >> 1
    return crc


@pandas_udf(T.LongType())
def shift_crc32(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(shifted(crc.to_numpy(np.int64).astype(np.uint32), after.to_numpy(np.int64)).astype(np.int64))


def combined_crc32(parts: DataFrame, by: list[str], crc: str, after: str) -> DataFrame:
    """CRC-32 of the parts put together in order: each part's CRC shifted by the bytes ``after`` it,
    added without carry.  The sum is taken map-side and knows no order, so no group is gathered."""
    return parts.groupBy(*by).agg(F.bit_xor(shift_crc32(F.col(crc), F.col(after))).alias("crc32"), F.count("*").alias("parts"))


def with_bytes_after(rows: DataFrame, by: list[str], order: str, size: str, block: int = 4096) -> DataFrame:
    """``rows`` with after: the bytes of the rows of their group that stand behind them.

    Sums run within blocks of the order and then over blocks, so that a group of any size is
    spread over tasks.  ``order`` is a number that no two rows of a group share."""
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    blocks = rows.groupBy(*by, "__block").agg(F.sum(size).alias("__sum"))
    later = Window.partitionBy(*by).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "__block", F.coalesce(F.sum("__sum").over(later), F.lit(0)).alias("__later"))
    behind = Window.partitionBy(*by, "__block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__behind", F.coalesce(F.sum(size).over(behind), F.lit(0)))
    return rows.join(blocks, [*by, "__block"]).withColumn("after", F.col("__later") + F.col("__behind")).drop("__block", "__later", "__behind")


def crc_hex(crc: Column) -> Column:
    return F.lpad(F.hex(crc), 8, "0")
