"""What keeps archive jobs bounded: small batches for Python, and archives that are read once."""

import pyarrow as pa
from pyspark.sql import functions as F

from bytelode.plans.archive_jobs import archive_table, restored_files, verified
from bytelode.sources.staging import LIMIT, MOST_BYTES, written


def test_python_gets_small_batches_whatever_the_rows(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(LIMIT)
    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 4096).cast("binary").alias("data"))
    got = [r["n"] for r in written(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) > 9000 * 4096 and max(got) < 2 * MOST_BYTES
    assert spark.conf.get(LIMIT) == before


def test_archives_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", b"hello world " * 40), ("b", bytes(range(256)) * 3)], "id string, data binary")
    archive_table(docs, "id", "data", "czip", "huffman", 200).withColumnRenamed("name", "path").write.parquet(f"{tmp_path}/made")
    files = spark.read.parquet(f"{tmp_path}/made")
    told, back = verified(files), restored_files(files)
    assert not [f for df in (told, back) for f in df.inputFiles() if str(tmp_path / "made") in f]
    assert {(r["path"], r["name"], r["size"], r["chunks"], r["status"]) for r in told.collect()} == {("a", "a", 480, 3, "ok"), ("b", "b", 768, 4, "ok")}
    pieces = sorted((r["path"], r["chunk_idx"], bytes(r["data"])) for r in back.collect())
    assert b"".join(p[2] for p in pieces if p[0] == "b") == bytes(range(256)) * 3


def test_null_and_empty_archives(spark):
    whole = bytes(archive_table(spark.createDataFrame([("a", b"abc" * 100)], "id string, data binary"), "id", "data", "czip", "huffman", 200).first()["content"])
    files = spark.createDataFrame([("n", None), ("e", b""), ("w", whole), ("m", whole[:25] + b"\xff" + whole[26:])], "path string, content binary")
    got = {r["path"]: (r["name"], r["status"]) for r in verified(files).collect()}
    assert got == {"n": (None, "magic"), "e": (None, "magic"), "w": ("a", "ok"), "m": ("\ufffd", "ok")}
