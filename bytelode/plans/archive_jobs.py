"""Archiving a table of payloads, verifying archives, and restoring what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import combined_crc32
from ..operators.chunks import CHUNK
from ..operators.compression import compress, crc_of_files, decoded
from ..sources.archives import archives, chunk_rows, headers, records, write_archives
from ..sources.staging import written


def archive_pieces(df: DataFrame, key: str, payload: str, container: str = "czip", method: str = "huffman", chunk: int = CHUNK, window: int = 32768) -> DataFrame:
    """(name, place, piece) of an archive of each payload; empty payloads have none.  Chunks are packed once, into a
    written table that a lost executor does not take along."""
    chunks = written(compress(df, key, payload, method, container, chunk, window), "packed")
    return records(chunks, crc_of_files(chunks, key, chunk), container, method, window, key)


def archive_table(df: DataFrame, key: str, payload: str, container: str = "czip", method: str = "huffman", chunk: int = CHUNK, window: int = 32768) -> DataFrame:
    """(name, content): an archive of each payload as one value; empty payloads have none."""
    return archives(archive_pieces(df, key, payload, container, method, chunk, window))


def archive_files(df: DataFrame, key: str, payload: str, folder: str, container: str = "czip", method: str = "huffman", chunk: int = CHUNK, window: int = 32768) -> None:
    """An archive of each payload as a file of ``folder``; the ``archives`` source must be registered."""
    write_archives(archive_pieces(df, key, payload, container, method, chunk, window), folder)


def _judged(checked: DataFrame) -> DataFrame:
    """(path, name, container, method, size, chunks, status) from the rows of ``chunk_rows``, as a written table."""
    read = checked.where("head IS NOT NULL").select("path", headers(F.col("head")).alias("header"))
    checked = checked.where("head IS NULL").select("path", "chunk_idx", "got", "crc", "fault")
    first = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("chunk_idx")))
    sums = checked.groupBy("path").agg(F.sum("got").alias("got_size"), F.count("*").alias("chunks"), first.alias("first_fault"), F.max("got").alias("full"))
    placed = checked.join(sums, "path").withColumn("after", F.col("got_size") - F.col("chunk_idx") * F.col("full") - F.col("got"))
    crcs = combined_crc32(placed.where("first_fault IS NULL AND after >= 0"), ["path"], "crc", "after").select("path", F.col("crc32").alias("got_crc"))
    out = read.join(sums, "path", "left").join(crcs, "path", "left")
    status = (
        F.when(F.col("header.error").isNotNull(), F.col("header.error"))
        .when(F.col("first_fault").isNotNull(), F.col("first_fault"))
        .when(~F.col("got_size").eqNullSafe(F.col("header.size")), "size")
        .when(~F.col("got_crc").eqNullSafe(F.col("header.crc32")), "crc")
        .otherwise("ok")
    )
    return out.select("path", "header.name", "header.container", "header.method", "header.size", F.coalesce("chunks", F.lit(0)).alias("chunks"), status.alias("status"))


def verified(files: DataFrame) -> DataFrame:
    """(path, name, container, method, size, chunks, status) of archives (path, content): ok, or the
    first fault: of the header, a record, a chunk, the whole size or the checksum."""
    return _judged(written(chunk_rows(files, decoded, False), "checked"))


def restored_files(files: DataFrame) -> DataFrame:
    """(path, name, chunk_idx, data) of the archives (path, content) that verify; of the others there is no row, so
    nothing partial is ever restored."""
    made = written(chunk_rows(files, decoded, True), "restored")
    sound = _judged(made).where("status = 'ok'").select("path", "name")
    return made.where("head IS NULL").join(sound, "path").select("path", "name", "chunk_idx", "data")


def restore(files: DataFrame, folder: str) -> DataFrame:
    """Write what the archives (path, content) hold to ``folder``, a file for each that verifies, and tell of all:
    (path, name, container, method, size, chunks, status)."""
    rows = restored_files(files)
    write_archives(rows.select("name", F.col("chunk_idx").alias("place"), F.col("data").alias("piece")), folder)
    return verified(files)
