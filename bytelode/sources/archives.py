"""Archives: a header, then chunk records of sizes and payload.

Layout, big-endian: magic (4), version 1, method (1), flags (1), window (4), size (8), CRC-32 (4), length of
the name (2), name, number of chunks (4); each record: packed size (4), original size (4, bit 31: stored
as it is), payload.  Whole archives are read through Spark's ``binaryFile`` source, larger ones record by record through
``archive_chunks``."""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.formats import METHODS, big_endian, read_big_endian
from ..functions.tokens import ranges

RAW_BIT, MOST_CHUNKS = 1 << 31, 1_048_576
CHUNK_SCHEMA = "path string, method int, chunk_idx int, orig_sz long, raw boolean, packed binary, error string"
CHUNK_TYPES = {"path": pa.string(), "method": pa.int32(), "chunk_idx": pa.int32(), "orig_sz": pa.int64(), "raw": pa.bool_(), "packed": pa.binary(), "error": pa.string()}
CHECKED_TYPES = {"path": pa.string(), "head": pa.binary(), "chunk_idx": pa.int32(), "got": pa.int64(), "crc": pa.int64(), "fault": pa.string(), "data": pa.binary()}
#: Records that a task reads at most.
PER_TASK = 256


def records(chunks: DataFrame, files: DataFrame, container: str, method: str, window: int, key: str) -> DataFrame:
    """(name, place, piece): what an archive of each ``name`` is written from, in order of ``place``: the header at -1, then a
    record for each chunk.  From chunk rows (key, chunk_idx, orig_sz, raw, packed, csz) and files (key, size, crc32, parts)."""
    size = F.col("orig_sz") + F.when(F.col("raw"), F.lit(RAW_BIT)).otherwise(F.lit(0).cast("long"))
    record = F.concat(big_endian(F.col("csz"), 4), big_endian(size, 4), F.col("packed"))
    name = F.encode(F.col(key).cast("string"), "UTF-8")
    head = F.concat(
        F.lit(container.upper().encode()),
        F.lit(bytes([1, METHODS[method], 0]) + window.to_bytes(4, "big")),
        big_endian(F.col("size"), 8),
        big_endian(F.col("crc32"), 4),
        big_endian(F.octet_length(name), 2),
        name,
        big_endian(F.col("parts"), 4),
    )
    named = F.col(key).cast("string").alias("name")
    heads = files.select(named, F.lit(-1).alias("place"), head.alias("piece"))
    return heads.unionByName(chunks.select(named, F.col("chunk_idx").alias("place"), record.alias("piece")))


def archives(pieces: DataFrame) -> DataFrame:
    """(name, content): the pieces of each archive put together into one value, hence under 1 GB; ``write_archives`` knows
    no such bound."""
    body = pieces.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("ps"))
    # bytes pass through strings as they are
    return body.select("name", F.array_join(F.transform("ps", lambda p: p["piece"].cast("string")), "").cast("binary").alias("content"))


def write_archives(pieces: DataFrame, folder: str) -> None:
    """Each archive as a file of ``folder``, piece after piece as they come in order; no archive is held whole."""
    placed = pieces.select(F.col("name"), F.col("place").cast("int").alias("place"), F.col("piece").alias("content"))
    placed.repartition("name").sortWithinPartitions("name", "place").write.format("archives").mode("append").save(folder)


def headers(content: Column) -> Column:
    """struct of the header's fields and ``error``: magic, version, method, short, chunks or null.  ``name`` has marks in
    place of bytes that are not UTF-8, ``name_bytes`` has them as they are."""
    at = F.octet_length(content)
    magic = F.decode(F.substring(content, 1, 4), "ISO-8859-1")
    n = read_big_endian(content, 23, 2)
    name = F.substring(content, F.lit(26), n.cast("int"))
    chunks = F.conv(F.hex(F.substring(content, (n + 26).cast("int"), F.lit(4))), 16, 10).cast("long")
    method = read_big_endian(content, 5, 1)
    error = (
        F.when(~magic.isin("CZIP", "CRAR"), "magic")
        .when(read_big_endian(content, 4, 1) != 1, "version")
        .when(at < 29, "short")
        .when(n + 29 > at, "short")
        .when(~method.isin(*METHODS.values()), "method")
        .when((chunks < 1) | (chunks > MOST_CHUNKS), "chunks")
    )
    return F.struct(
        magic.alias("container"),
        method.cast("int").alias("method"),
        read_big_endian(content, 6, 1).cast("int").alias("flags"),
        read_big_endian(content, 7, 4).alias("window"),
        F.when(at >= 19, F.conv(F.hex(F.substring(content, 12, 8)), 16, 10).cast("decimal(20,0)").cast("long")).alias("size"),
        read_big_endian(content, 19, 4).alias("crc32"),
        F.make_valid_utf8(name.cast("string")).alias("name"),
        name.alias("name_bytes"),
        chunks.alias("n_chunks"),
        error.alias("error"),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, header, content) of every archive under ``path``; for archives under 2 GB each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", headers(F.col("content")).alias("header"), "content")


def record_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK_SCHEMA, about ``most`` bytes at a time, of archives (content, path, method, at, n), which are taken one by one."""
    rows, held = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNK_TYPES.values())], names=list(CHUNK_TYPES))

    for batch in batches:
        for i in range(batch.num_rows):
            content, path, method, at, n = (c[i].as_py() for c in batch.columns)
            for row in _walked(io.BytesIO(content), len(content), at, 0, n):
                rows.append((path, method, *row))
                held += len(row[3] or b"") + 64
                if held > most:
                    yield made()
                    rows, held = [], 0
    if rows:
        yield made()


def chunk_rows(files: DataFrame, decode: Callable[[bytes, int], bytes | None], with_data: bool) -> DataFrame:
    """Of archives (path, content) a row with head, which is what ``headers`` reads, and one for each record of those with a sound
    header: path, chunk_idx, got (bytes), crc and fault, with data if it is asked for.  A record that runs past the end is reported and
    ends its archive.  Archives are read once, and their chunks decoded where they are read, by ``decode(packed, method)``,
    which gives null for what does not decode."""
    columns = {k: t for k, t in CHECKED_TYPES.items() if with_data or k != "data"}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.values())], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for lo, hi in ranges(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), most, 4096):
                for path, content in zip(*(c[lo:hi].to_pylist() for c in batch.columns)):
                    content = content or b""
                    rows.append((path, content[: 29 + int.from_bytes(content[23:25], "big")], *[None] * (len(columns) - 2)))
                    held += len(rows[-1][1]) + 64
                    if (sound := _sound(content)) is None:
                        continue
                    method, at, n = sound
                    for i, size, raw, packed, fault in _walked(io.BytesIO(content), len(content), at, 0, n):
                        data = packed if raw or packed is None else decode(packed, method)
                        got, crc = (None, None) if data is None else (len(data), zlib.crc32(data))
                        fault = fault or ("chunk decode" if data is None else "chunk size" if got != size else None)
                        rows.append((path, None, i, got, crc, fault, data)[: len(columns)])
                        held += 64 + (len(data or b"") if with_data else 0)
                        if held > most:
                            yield made(rows)
                            rows, held = [], 0
        if rows:
            yield made(rows)

    kinds = "path string, head binary, chunk_idx int, got long, crc long, fault string"
    return files.select("path", "content").mapInArrow(run, kinds + ", data binary" * with_data)


def _sound(content: bytes) -> tuple[int, int, int] | None:
    """Method, first record's place and number of records where ``headers`` finds no error."""
    if len(content) < 29 or content[:4] not in (b"CZIP", b"CRAR") or content[4] != 1 or content[5] not in METHODS.values():
        return None
    at = 29 + int.from_bytes(content[23:25], "big")
    n = int.from_bytes(content[at - 4 : at], "big")
    return (content[5], at, n) if at <= len(content) and 1 <= n <= MOST_CHUNKS else None


def _walked(file, length: int, at: int, first: int, stop: int) -> Iterator[tuple]:
    """chunk_idx, orig_sz, raw, packed, error of the records from ``first`` to ``stop``; those before are
    passed over by their sizes."""
    for i in range(stop):
        file.seek(at)
        sizes = file.read(8)
        if len(sizes) < 8:
            yield i, None, None, None, "cut off"
            return
        csz, size = struct.unpack(">II", sizes)
        raw, size = bool(size & RAW_BIT), size & RAW_BIT - 1
        used = size if raw else csz
        if at + 8 + used > length:
            yield i, size, raw, None, "cut off"
            return
        if i >= first:
            yield i, size, raw, file.read(used), None
        at += 8 + used


class ArchiveChunks(DataSource):
    """``spark.read.format("archive_chunks").load(folder)``: the chunk records of archives of any size.

    Only headers are read to plan; each task reads ``per_task`` records of one archive, passing over those before.
    ``folder`` is any address that pyarrow's file systems know.  With ``headersOnly`` one row for each archive is read, without
    records: chunk_idx is null."""

    @classmethod
    def name(cls) -> str:
        return "archive_chunks"

    def schema(self) -> str:
        return f"{CHUNK_SCHEMA}, container string, size long, crc32 long, name binary, n_chunks long"

    def reader(self, schema) -> DataSourceReader:
        return _Chunks(self.options["path"], self.options.get("headersonly", "false").lower() == "true", int(self.options.get("pertask", PER_TASK)))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")


class _Part(InputPartition):
    def __init__(self, file: str, length: int, head: tuple, at: int, first: int, stop: int):
        self.file, self.length, self.head, self.at, self.first, self.stop = file, length, head, at, first, stop


class _Chunks(DataSourceReader):
    def __init__(self, path: str, heads_only: bool, per_task: int):
        self.path, self.heads_only, self.per_task = path, heads_only, per_task

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _file_system(self.path)
        files = store.get_file_info(fs.FileSelector(base, recursive=True)) if store.get_file_info(base).type == fs.FileType.Directory else [store.get_file_info(base)]
        out = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            with store.open_input_file(f.path) as file:
                start = file.read(25)
                if len(start) < 25 or start[:4] not in (b"CZIP", b"CRAR") or start[4] != 1:
                    out.append(_Part(f.path, f.size, (None, None, None, None, None, None), 0, 0, 0))
                    continue
                n = int.from_bytes(start[23:25], "big")
                name, chunks = file.read(n), int.from_bytes(file.read(4), "big")
            head = (start[:4].decode(), start[5], int.from_bytes(start[11:19], "big"), int.from_bytes(start[19:23], "big"), name, chunks)
            stop = 0 if self.heads_only or not 0 < chunks <= MOST_CHUNKS else chunks
            out += [_Part(f.path, f.size, head, 29 + n, lo, min(stop, lo + self.per_task)) for lo in range(0, max(stop, 1), self.per_task)]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        container, method, size, crc32, name, chunks = part.head
        rest = (container, size, crc32, name, chunks)
        if part.stop == 0:
            fault = None if self.heads_only and container else "header"
            yield (part.file, method, None, None, None, None, fault, *rest)
            return
        store, _ = _file_system(self.path)
        with store.open_input_file(part.file) as file:
            for row in _walked(file, part.length, part.at, part.first, part.stop):
                if row[4] is None or row[0] >= part.first:  # a fault before this part is told by the part it is in
                    yield (part.file, method, *row, *rest)


class ArchiveFiles(DataSource):
    """``df.write.format("archives").save(folder)`` for (name, content) rows, or for (name, place, content) rows that are sorted
    by name and place and of which a name's are in one partition: a file for each name, written aside and named when all
    tasks are done, so a failed run leaves no partial file.  Names keep no folders; two rows or two names that would be one
    file are an error.  ``folder`` is any address that pyarrow's file systems know and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options["path"], "place" in schema.fieldNames())


class _Files(DataSourceWriter):
    def __init__(self, path: str, pieces: bool):
        self.path, self.pieces = path, pieces

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, folder = _file_system(self.path)
        store.create_dir(folder, recursive=True)
        mark = f".part-{TaskContext.get().taskAttemptId()}"
        done, name, file = [], None, None
        for row in iterator:
            if not self.pieces or row["name"] != name:
                if file:
                    file.close()
                name = row["name"]
                own = os.path.basename(name.replace("\\", "/")) or "archive"
                aside = f"{folder}/.{len(done)}{mark}"
                done.append((aside, f"{folder}/{own}"))
                file = store.open_output_stream(aside)
            file.write(row["content"])
        if file:
            file.close()
        message = WriterCommitMessage()
        message.files = done
        return message

    def commit(self, messages) -> None:
        store, _ = _file_system(self.path)
        files = [f for message in messages for f in message.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows or names would be one file")
        for aside, name in files:
            store.move(aside, name)

    def abort(self, messages) -> None:
        store, _ = _file_system(self.path)
        for message in messages:
            for aside, _ in message.files if message else ():
                store.delete_file(aside)
