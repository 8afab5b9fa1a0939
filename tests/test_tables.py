"""Operators on small tables: chunks, detection, archives, resume and streaming."""

import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytelode.functions.checksums import combined_crc32, with_bytes_after
from bytelode.functions.detect import detect, packed_warning
from bytelode.functions.formats import big_endian, format_name, human_size, method_name, one_decimal, output_name, ratio_text, read_big_endian
from bytelode.operators.chunks import byte_histogram, chunked, context_counts
from bytelode.functions.codecs import huffman_encode
from bytelode.operators.compression import compress, compressed, crc_of_files, huffman_size, restored
from bytelode.operators.resume import fingerprint, pending
from bytelode.plans.archive_jobs import archive_files, archive_table, restore, verified
from bytelode.sources.archives import ArchiveChunks, ArchiveFiles, read_archives, record_batches
from bytelode.sources.staging import Staging
from bytelode.streaming.ingest import compress_arrivals

BLOBS = {"a": b"hello world " * 40, "b": bytes(range(256)) * 3, "c": b"x", "empty": b"", "null": None}


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame([(k, v) for k, v in BLOBS.items()], "id string, data binary")


def test_chunks(blobs):
    rows = chunked(blobs, "id", "data", 100).orderBy("id", "chunk_idx").collect()
    for key in ("a", "b", "c"):
        assert b"".join(r["data"] for r in rows if r["id"] == key) == BLOBS[key]
    assert {r["id"] for r in rows} == {"a", "b", "c"}


@pytest.mark.parametrize(
    "head,mime,text,archive",
    [
        (b"PK\x03\x04", "application/zip", False, True),
        (b"%PDF-", "application/pdf", False, False),
        (b"\x89PNG\r\n\x1a\n", "image/png", False, False),
        (b"\x7fELF", "application/x-elf", False, False),
        (b"\x1f\x8b\x08", "application/gzip", False, True),
        (b"CZIP\x01", "application/x-czip", False, True),
        (b"CRAR\x01", "application/x-crar", False, True),
        (b"some plain text of thirty bytes or so", "text/plain", True, False),
        (b"too short", "application/octet-stream", False, False),
        (b"text with a zero byte \x00 in it, rather long", "application/octet-stream", False, False),
        (b"\xef\xbb\xbftext with a mark, rather long", "text/plain", False, False),
        (b"", "application/octet-stream", False, False),
        (None, "application/octet-stream", False, False),
    ],
)
def test_detect(spark, head, mime, text, archive):
    d = spark.createDataFrame([(head,)], "b binary").select(detect(F.col("b")).alias("d")).first()["d"]
    assert (d["mime"], d["is_text"], d["is_archive"]) == (mime, text, archive)


# Fixed values, apart from the library's list: head, type, extension, archive
SIGNED = [
    ("504B0304", "application/zip", ".zip", True),
    ("526172211A07", "application/x-rar", ".rar", True),
    ("1F8B", "application/gzip", ".gz", True),
    ("425A68", "application/x-bzip2", ".bz2", True),
    ("FD377A585A00", "application/x-xz", ".xz", True),
    ("377ABCAF271C", "application/x-7z", ".7z", True),
    ("435A4950", "application/x-czip", ".czip", True),
    ("43524152", "application/x-crar", ".crar", True),
    ("89504E470D0A1A0A", "image/png", ".png", False),
    ("FFD8FF", "image/jpeg", ".jpg", False),
    ("47494638", "image/gif", ".gif", False),
    ("424D", "image/bmp", ".bmp", False),
    ("52494646", "image/webp", ".webp", False),
    ("494433", "audio/mpeg", ".mp3", False),
    ("0000000066747970", "video/mp4", ".mp4", False),
    ("0000001866747970", "video/mp4", ".mp4", False),
    ("25504446", "application/pdf", ".pdf", False),
    ("D0CF11E0A1B11AE1", "application/msword", ".doc", False),
    ("3C3F786D6C", "text/xml", ".xml", False),
    ("3C68746D6C", "text/html", ".html", False),
    ("7F454C46", "application/x-elf", ".elf", False),
    ("4D5A", "application/x-msdownload", ".exe", False),
    ("EFBBBF", "text/plain", ".txt", False),
]


def test_signatures(spark):
    df = spark.createDataFrame([(i, bytes.fromhex(h)) for i, (h, *_) in enumerate(SIGNED)], "i int, b binary")
    rows = df.select("i", detect(F.col("b")).alias("d"), packed_warning(F.col("b")).alias("w")).orderBy("i").collect()
    assert [(r["d"]["mime"], r["d"]["extension"], r["d"]["is_archive"]) for r in rows] == [s[1:] for s in SIGNED]
    assert [r["w"] is not None for r in rows] == [s[3] for s in SIGNED] and not any(r["d"]["is_text"] for r in rows)


def test_statistics_of_groups_and_cuts(spark):
    values = [bytes([i % 7, 200, i % 3]) * (i % 50) for i in range(300)]
    df = spark.createDataFrame([(i % 4, v) for i, v in enumerate(values)], "g int, b binary")
    want, pairs = Counter(), Counter()
    for i, v in enumerate(values):
        want.update((i % 4, x) for x in v)
        pairs.update(zip(v, v[1:]))
    assert {(r["g"], r["byte"]): r["n"] for r in byte_histogram(df, "b", "g").collect()} == want
    assert {(r["prev"], r["byte"]): r["n"] for r in context_counts(df, "b").collect()} == pairs
    sizes = df.select("b", huffman_size("b").alias("n")).collect()
    assert all(r["n"] == len(huffman_encode(bytes(r["b"]))) for r in sizes)


def test_statistics(spark):
    df = spark.createDataFrame([(b"aab",), (b"ba",), (b"",), (None,)], "b binary")
    assert {r["byte"]: r["n"] for r in byte_histogram(df, "b").collect()} == {97: 3, 98: 2}
    assert {(r["prev"], r["byte"], r["n"], r["below"]) for r in context_counts(df, "b").collect()} == {(97, 97, 1, 0), (97, 98, 1, 1), (98, 97, 1, 0)}


def test_formats(spark):
    row = spark.range(1).select(
        *(human_size(F.lit(n)).alias(f"s{i}") for i, n in enumerate((5, 2047, 3 << 20, 5 << 29))),
        output_name(F.lit("x.czip"), F.lit(True), F.lit("czip")).alias("a"),
        output_name(F.lit(".czip"), F.lit(True), F.lit("czip")).alias("b"),
        read_big_endian(big_endian(F.lit(0xDEADBEEF), 4), 0, 4).alias("n"),
        read_big_endian(F.lit(b"\x01"), 0, 4).alias("short"),
    ).first()
    assert tuple(row) == ("5 B", "1 KB", "3 MB", "2.5 GB", "x", ".czip_restored", 0xDEADBEEF, None)


def test_names(spark):
    row = spark.range(1).select(*(method_name(F.lit(m)).alias(m) for m in ("huffman", "lz77", "lzss_rnc")), *(format_name(F.lit(c)).alias(c) for c in ("czip", "crar")), ratio_text(F.lit(0.1234)).alias("r")).first()
    assert tuple(row) == ("Huffman", "LZ77 + Huffman", "LZSS + RNC", "CZIP", "CRAR", "12.3%")


def test_one_decimal_is_that_of_c(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 0.95, 0.96, 6.25, 6.75, 9.95, 99.95, -6.25, 2.0**40 + 0.75, 2.0**49 + 0.5]
    values += [n * 25 / 2048 for n in range(0, 60_000, 64)] + [n / 20 for n in range(4000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", one_decimal(F.col("x")).alias("s"), ratio_text(F.col("x") / 100).alias("r")).collect()
    assert [r["s"] for r in rows] == [f"{r['x']:.1f}" for r in rows]
    assert [r["r"] for r in rows] == [f"{r['x'] / 100 * 100:.1f}%" for r in rows]
    sizes = [(2 * k + 1) << 28 for k in range(4, 40)]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(human_size(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{n / 2**30:.1f} GB" for n in sizes]


def test_corpus_crc(spark):
    parts = [(g, i, f"{g}{i}".encode() * i) for g in "xy" for i in range(30)]
    rows = spark.createDataFrame(parts, "g string, i int, d binary").select("g", "i", F.crc32("d").alias("c"), F.octet_length("d").alias("n"))
    got = {r["g"]: r["crc32"] for r in combined_crc32(with_bytes_after(rows, ["g"], "i", "n", block=7), ["g"], "c", "after").collect()}
    assert got == {g: zlib.crc32(b"".join(d for h, _, d in parts if h == g)) for g in "xy"}


@pytest.mark.parametrize("method,container", [("huffman", "czip"), ("lz77", "czip"), ("lzss_rnc", "crar")])
def test_compress_and_restore(blobs, method, container):
    rows = compress(blobs, "id", "data", method, container, 200).cache()
    back = restored(rows, method).orderBy("id", "chunk_idx").collect()
    assert all(r["error"] is None for r in back)
    for key in ("a", "b", "c"):
        assert b"".join(r["data"] for r in back if r["id"] == key) == BLOBS[key]
    assert {r["id"]: r["crc32"] for r in crc_of_files(rows, "id", 200).collect()} == {k: zlib.crc32(BLOBS[k]) for k in "abc"}


def test_containers_refuse(blobs):
    with pytest.raises(ValueError):
        compress(blobs, "id", "data", "huffman", "crar")


def test_archives(spark, blobs, tmp_path):
    made = archive_table(blobs, "id", "data", "czip", "lz77", 200)
    spark.dataSource.register(ArchiveFiles)
    made.write.format("archives").mode("append").save(str(tmp_path / "out"))
    read = read_archives(spark, str(tmp_path / "out"))
    assert sorted(r["header"]["name"] for r in read.collect()) == ["a", "b", "c"]
    assert {r["status"] for r in verified(read).collect()} == {"ok"}
    whole = {r["name"]: bytes(r["content"]) for r in made.collect()}["b"]
    bad = {
        "magic": b"JUNK" + bytes(50),
        "short": whole[:20],
        "cut off": whole[:-3],
        "crc": whole[:-5] + bytes([whole[-5] ^ 1]) + whole[-4:],
        "size": whole[:18] + b"\x07" + whole[19:],
        "chunks": whole[:26] + bytes(4),
    }
    status = {r["path"]: r["status"] for r in verified(spark.createDataFrame(list(bad.items()), "path string, content binary")).collect()}
    assert status == {k: k for k in bad}


def test_archives_of_any_size(spark, blobs, tmp_path):
    for source in (ArchiveFiles, ArchiveChunks):
        spark.dataSource.register(source)
    archive_files(blobs, "id", "data", str(tmp_path / "out"), "crar", "lzss_rnc", 100)
    whole = {r["name"]: bytes(r["content"]) for r in archive_table(blobs, "id", "data", "crar", "lzss_rnc", 100).collect()}
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if f.name[0] != "."} == whole
    (tmp_path / "out" / "b").write_bytes(whole["b"][:-4])
    rows = spark.read.format("archive_chunks").option("perTask", "3").load(str(tmp_path / "out")).collect()
    assert Counter((bytes(r["name"]), r["error"]) for r in rows) == {(b"a", None): 5, (b"b", None): 7, (b"b", "cut off"): 1, (b"c", None): 1}
    assert len({(r["path"], r["chunk_idx"]) for r in rows}) == len(rows)
    heads = spark.read.format("archive_chunks").option("headersOnly", "true").load(str(tmp_path / "out")).collect()
    assert sorted((bytes(r["name"]), r["n_chunks"], r["size"]) for r in heads) == [(b"a", 5, 480), (b"b", 8, 768), (b"c", 1, 1)]
    told = restore(read_archives(spark, str(tmp_path / "out")), str(tmp_path / "back"))
    assert {r["name"]: r["status"] for r in told.collect()} == {"a": "ok", "b": "cut off", "c": "ok"}
    assert {f.name: f.read_bytes() for f in (tmp_path / "back").iterdir() if f.name[0] != "."} == {k: BLOBS[k] for k in "ac"}


def test_records_come_in_batches_of_many_archives():
    content = b"".join(n.to_bytes(4, "big") + (n | 1 << 31).to_bytes(4, "big") + bytes(n) for n in (1000, 500))
    rows = 3000
    read = pa.RecordBatch.from_arrays([pa.array(x) for x in ([content] * rows, [str(i) for i in range(rows)], [0] * rows, [0] * rows, [2] * rows)], names=["content", "path", "method", "at", "n"])
    made = list(record_batches(iter([read])))
    assert len(made) < 6 and all(b.nbytes < 3 << 20 for b in made)
    got = [r for b in made for r in b.to_pylist()]
    assert [(r["path"], r["chunk_idx"], len(r["packed"]), r["raw"], r["error"]) for r in got] == [(str(i), k, n, True, None) for i in range(rows) for k, n in enumerate((1000, 500))]


def test_odd_names_and_first_faults(spark, blobs, tmp_path):
    whole = {r["name"]: bytes(r["content"]) for r in archive_table(blobs, "id", "data", "czip", "huffman", 100).collect()}
    named = whole["c"][:25] + b"\xff" + whole["c"][26:]
    first = whole["b"].index((100).to_bytes(4, "big"), 30) - 4
    broken = bytearray(whole["b"])
    for at in (first, len(broken) - 30):  # the first record's packed bytes run past the end, a later one is changed
        broken[at : at + 1] = b"\x7f"
    files = spark.createDataFrame([("n", named), ("f", bytes(broken))], "path string, content binary")
    got = {r["path"]: (r["name"], r["status"]) for r in verified(files).collect()}
    assert got["n"] == ("\ufffd", "ok") and got["f"][1] != "ok"
    spark.dataSource.register(ArchiveFiles)
    two = spark.createDataFrame([("x/a", b"1"), ("y/a", b"2")], "name string, content binary")
    with pytest.raises(Exception, match="one file"):
        two.write.format("archives").mode("append").save(str(tmp_path / "two"))
    assert not [f for f in (tmp_path / "two").iterdir() if not f.name.endswith(".crc")]


def test_staging_goes_on_from_an_earlier_run(spark, blobs, tmp_path):
    options = fingerprint(method="huffman")
    chunks = chunked(blobs, "id", "data", 200)
    staging = Staging(spark, str(tmp_path / "staging"))
    assert not staging.exists()
    staging.save(compressed(chunks.where("chunk_idx < 2"), "huffman").drop("data").withColumn("options", F.lit(options)))
    (tmp_path / "staging" / "part=broken").mkdir()  # of a run that broke off
    again = Staging(spark, str(tmp_path / "staging"))
    left = pending(chunks, again.load(), "id", options)
    assert {(r["id"], r["chunk_idx"]) for r in left.collect()} == {("a", 2), ("b", 2), ("b", 3)}
    again.save(compressed(left, "huffman").drop("data").withColumn("options", F.lit(options)))
    assert again.load().count() == chunks.count() and not pending(chunks, again.load(), "id", options).count()
    again.remove()
    assert not again.exists() and not (tmp_path / "staging").exists()


def test_resume(blobs):
    options = fingerprint(method="huffman")
    chunks = chunked(blobs, "id", "data", 200)
    done = compressed(chunks.where("chunk_idx < 2"), "huffman").withColumn("options", F.lit(options))
    left = {(r["id"], r["chunk_idx"]) for r in pending(chunks, done, "id", options).collect()}
    assert left == {("a", 2), ("b", 2), ("b", 3)}
    assert pending(chunks, done, "id", "other").count() == chunks.count()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_bytes(BLOBS["a"])
    for expected in (1, 2):
        compress_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).select("path").distinct().count() == expected
        (tmp_path / "in" / "two").write_bytes(BLOBS["b"])


def test_sql_functions(spark):
    from bytelode.functions.sql import METHODS, register

    register(spark)
    row = spark.sql("SELECT crc16(X'313233343536373839') c, " + ", ".join(f"{m}_decode({m}_encode(X'616263616263')) {m}" for m in METHODS)).first()
    assert row["c"] == 0xFEE8 and all(bytes(row[m]) == b"abcabc" for m in METHODS)
