"""The column functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .checksums import crc16, shift_crc32
from .codecs import decoder, encoder

METHODS = ("huffman", "lz77", "lzss_rnc", "lz77_only", "lzss_only", "rnc_only")


def register(spark: SparkSession) -> None:
    """``crc16``, ``shift_crc32`` and for each method ``<method>_encode`` and ``<method>_decode``."""
    spark.udf.register("crc16", crc16)
    spark.udf.register("shift_crc32", shift_crc32)
    for method in METHODS:
        spark.udf.register(f"{method}_encode", encoder(method))
        spark.udf.register(f"{method}_decode", decoder(method))
