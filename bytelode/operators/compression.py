"""Compression of chunk tables, its inverse and what it saves."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..functions.checksums import combined_crc32
from ..functions.codecs import decoder, encoder, method_codecs
from ..functions.formats import ALLOWED, METHODS
from .chunks import CHUNK, chunked

#: Bytes before the code bits: lengths, size and padding.
HUFFMAN_HEAD = 265


def compressed(chunks: DataFrame, method: str, window: int = 32768) -> DataFrame:
    """``chunks`` (.., data) with orig_sz, crc32, packed, raw and csz: a chunk that would not shrink is
    stored as it is.  The encoded value is a column of its own, so it is computed once."""
    coded = chunks.withColumn("__coded", encoder(method, window)("data"))
    raw = F.octet_length("__coded") >= F.octet_length("data")
    return coded.select(
        *chunks.columns,
        F.octet_length("data").alias("orig_sz"),
        F.crc32("data").alias("crc32"),
        F.when(raw, F.col("data")).otherwise(F.col("__coded")).alias("packed"),
        raw.alias("raw"),
    ).withColumn("csz", F.octet_length("packed"))


def compress(df: DataFrame, id_col: str, payload: str, method: str, container: str, chunk: int = CHUNK, window: int = 32768) -> DataFrame:
    """(id, chunk_idx, orig_sz, crc32, packed, raw, csz) of all payloads; refuses a method that the
    container may not hold."""
    if method not in ALLOWED[container]:
        raise ValueError(f"{container} does not hold {method}")
    return compressed(chunked(df, id_col, payload, chunk), method, window).drop("data")


def restored(chunks: DataFrame, method: str, on_error: str = "fail") -> DataFrame:
    """``chunks`` (packed, raw, orig_sz, crc32) with data and error: size, or crc, or decode, or null."""
    coded = chunks.withColumn("__data", decoder(method, on_error=on_error)(F.when(~F.col("raw"), F.col("packed"))))
    data = F.when(F.col("raw"), F.col("packed")).otherwise(F.col("__data"))
    rows = coded.withColumn("data", data).drop("__data")
    error = (
        F.when(F.col("data").isNull(), "decode")
        .when(F.octet_length("data") != F.col("orig_sz"), "size")
        .when(F.crc32("data") != F.col("crc32"), "crc")
    )
    return rows.withColumn("error", error)


_DECODERS = {code: method_codecs(name)[1] for name, code in METHODS.items()}


def decoded(packed: bytes, method: int) -> bytes | None:
    """A chunk decoded by the code of its method; null if it does not decode."""
    try:
        return _DECODERS[method](packed)
    except (ValueError, KeyError):
        return None


def crc_of_files(chunks: DataFrame, by: str, chunk: int = CHUNK) -> DataFrame:
    """(by, crc32, parts, size) of whole payloads from their chunks' checksums.

    All chunks but the last are full, so the bytes behind one follow from its number and the total."""
    sizes = chunks.groupBy(by).agg(F.sum("orig_sz").alias("size"))
    after = F.col("size") - F.col("chunk_idx").cast("long") * chunk - F.col("orig_sz")
    placed = chunks.join(sizes, by).withColumn("after", after)
    return combined_crc32(placed, [by, "size"], "crc32", "after")


def savings(chunks: DataFrame, *by: str) -> DataFrame:
    """Sizes, share and stored chunks, of all chunks whatever run made them."""
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.sum("orig_sz").alias("orig_bytes"),
        F.sum("csz").alias("packed_bytes"),
        F.sum(F.col("raw").cast("int")).alias("stored_raw"),
    )


def huffman_bits(counts: Sequence[int]) -> int:
    """Bits of an optimal code for symbols of these counts: the sum of all merged weights, the two
    least merged again and again; a single symbol takes one bit each."""
    if len(counts) == 1:
        return counts[0]
    heap, bits = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heap[0]
        heapq.heapreplace(heap, pair)
        bits += pair
    return bits


@pandas_udf(LongType())
def huffman_size(content: pd.Series) -> pd.Series:
    """Bytes that the Huffman codec makes of a value, from its byte counts alone."""

    def one(value) -> int:
        counts = np.bincount(np.frombuffer(value, np.uint8), minlength=256)
        return HUFFMAN_HEAD + -(-huffman_bits(counts[counts > 0].tolist() or [0]) // 8)

    return content.map(one, na_action="ignore").astype("Int64")
