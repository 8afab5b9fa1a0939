"""The registered queries on bytes, chunks, codecs and archives, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.checksums import POLY32, combined_crc32, crc16, crc16_table, crc_hex, with_bytes_after
from .functions.codecs import decoder, encoder
from .functions.detect import detect, packed_warning
from .functions.formats import human_size, output_name, ratio_text
from .operators.chunks import byte_histogram as histogram
from .operators.chunks import chunked
from .operators.chunks import context_counts as contexts
from .operators.compression import compressed, restored, savings
from .operators.compression import huffman_size as size_of_code
from .operators.resume import fingerprint, pending
from .plans.archive_jobs import archive_table, restored_files, verified
from .sources.archives import headers
from .sources.staging import Staging

BLOCK = 4096


def payloads(spark: SparkSession, sf_dir: str, table: str = "documents", text: str = "text", *keys: str) -> DataFrame:
    """A table's texts as UTF-8 bytes."""
    keys = keys or ("doc_id",)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, F.encode(text, "UTF-8").alias("data"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt out to all cores only if it has fewer splits than there are cores: codec work would
    starve then; larger tables stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select("doc_id", detect(F.col("data")).alias("d")).select("doc_id", "d.*")


def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir, "pages", "html", "page_id").select("page_id", detect(F.col("data")).alias("d")).select("page_id", "d.*")


def detect_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_documents(spark, sf_dir).groupBy("mime", "is_text").agg(F.count("*").alias("n"))


def chunk_plan_4k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunked(payloads(spark, sf_dir), "doc_id", "data", BLOCK)
    return rows.select("doc_id", "chunk_idx", F.octet_length("data").alias("n_bytes"), F.md5("data").alias("digest"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(payloads(spark, sf_dir), "data")


def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(payloads(spark, sf_dir), "data")


def crc32_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select("doc_id", F.crc32("data").alias("crc32"), crc_hex(F.crc32("data")).alias("crc_hex"))


def crc16_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(payloads(spark, sf_dir)).select("doc_id", crc16("data").alias("crc16"))


def crc32_combined_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir, "documents", "text", "doc_id", "source").select("doc_id", "source", F.crc32("data").alias("crc"), F.octet_length("data").cast("long").alias("n"))
    return combined_crc32(with_bytes_after(rows, ["source"], "doc_id", "n"), ["source"], "crc", "after")


def huffman_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(payloads(spark, sf_dir)).select("doc_id", F.octet_length("data").alias("n_bytes"), size_of_code("data").alias("coded_bytes"))


def huffman_store_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = huffman_size(spark, sf_dir)
    return rows.select(
        "doc_id", F.col("n_bytes").alias("orig_sz"), F.least(F.col("n_bytes").cast("long"), "coded_bytes").alias("csz"), (F.col("coded_bytes") >= F.col("n_bytes")).alias("raw")
    )


def content_types_and_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, chunk count, CRC-32 and packed size of every document: the flagship query.  What is known of the whole
    payload goes with its chunks, so the table is read once and only narrow rows are shuffled."""
    docs = spread(payloads(spark, sf_dir)).withColumns({"mime": detect(F.col("data"))["mime"], "crc32": F.crc32("data")})
    rows = chunked(docs, "doc_id", "data", BLOCK, "mime", "crc32").withColumn("coded", size_of_code("data"))
    n = F.octet_length("data").cast("long")
    rows = rows.select("doc_id", "mime", "crc32", n.alias("orig_sz"), F.least(n, "coded").alias("csz"), (F.col("coded") >= n).alias("raw"))
    return savings(rows, "doc_id", "mime", "crc32")


def _roundtrip(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        coded = spread(payloads(spark, sf_dir)).select("doc_id", encoder(method)("data").alias("coded"))
        back = coded.select("doc_id", decoder(method)("coded").alias("data"))
        return back.select("doc_id", F.octet_length("data").alias("n_bytes"), F.md5("data").alias("digest"))

    run.__name__ = f"roundtrip_{method}"
    return run


def archive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = archive_table(spread(payloads(spark, sf_dir)), "doc_id", "data", "czip", "huffman", BLOCK)
    return made.select(headers(F.col("content")).alias("h")).select("h.name", "h.container", "h.method", "h.size", "h.crc32", "h.n_chunks")


def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = archive_table(spread(payloads(spark, sf_dir)), "doc_id", "data", "crar", "lzss_rnc", BLOCK)
    return verified(made.withColumnRenamed("name", "path")).select("path", "size", "chunks", "status")


def _damaged(content: Column, kind: Column) -> Column:
    """``content`` with the damage of its kind: 0 none, 1 magic, 2 version, 3 method, 4 size, 5 checksum, 6 no chunks, 7 the end cut off."""

    def put(at: Column, value: bytes) -> Column:
        rest = F.substring(content, at + len(value) + 1, F.octet_length(content))
        return F.concat(F.substring(content, F.lit(1), at), F.lit(value), rest)

    after_name = (F.conv(F.hex(F.substring(content, 24, 2)), 16, 10).cast("int") + 25).cast("int")
    return (
        F.when(kind == 1, put(F.lit(0), b"ZIPC"))
        .when(kind == 2, put(F.lit(4), b"\x02"))
        .when(kind == 3, put(F.lit(5), b"\x09"))
        .when(kind == 4, put(F.lit(11), b"\x7f"))
        .when(kind == 5, F.concat(F.substring(content, F.lit(1), F.lit(19)), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(content, 20, 4)), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 8, "0")), F.substring(content, F.lit(24), F.octet_length(content))))
        .when(kind == 6, put(after_name, bytes(4)))
        .when(kind == 7, F.substring(content, F.lit(1), F.octet_length(content) - 1))
        .otherwise(content)
    )


def archive_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of damaged archives: the number modulo eight of the document is the kind of damage."""
    made = archive_table(spread(payloads(spark, sf_dir)), "doc_id", "data", "czip", "huffman", BLOCK)
    kind = F.pmod(F.col("name").cast("long"), F.lit(8))
    made = made.select(F.col("name").alias("path"), _damaged(F.col("content"), kind).alias("content"))
    return verified(made).select("path", "status")


def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks restored from archives of the documents, those that verify; the others hold no row."""
    made = archive_table(spread(payloads(spark, sf_dir)), "doc_id", "data", "czip", "huffman", BLOCK)
    back = restored_files(made.withColumnRenamed("name", "path"))
    return back.select(F.col("name").cast("long").alias("doc_id"), "chunk_idx", F.octet_length("data").alias("n_bytes"), F.md5("data").alias("digest"))


def packed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warning that packing gives for each document, and for its archive if it were packed again."""
    docs = spread(payloads(spark, sf_dir))
    made = archive_table(docs, "doc_id", "data", "czip", "huffman", BLOCK)
    again = made.select(F.col("name").cast("long").alias("doc_id"), F.lit(True).alias("packed"), packed_warning(F.col("content")).alias("warning"))
    return docs.select("doc_id", F.lit(False).alias("packed"), packed_warning(F.col("data")).alias("warning")).unionByName(again)


def resume_equals_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks packed in two runs, the second reading what the first wrote to its staging table and packing the rest."""
    options = fingerprint(method="huffman", chunk=BLOCK)
    chunks = chunked(spread(payloads(spark, sf_dir)), "doc_id", "data", BLOCK)
    staging = Staging.beside(spark, "resume")
    staging.save(compressed(chunks.where("chunk_idx = 0"), "huffman").drop("data").withColumn("options", F.lit(options)))
    rest = compressed(pending(chunks, staging.load(), "doc_id", options), "huffman").drop("data").withColumn("options", F.lit(options))
    staging.save(rest)
    both = staging.load().groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("orig_sz").alias("orig_bytes"), F.bit_xor(F.col("crc32")).alias("mark"))
    return both.select("doc_id", "chunks", "orig_bytes", "mark")


def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir).select("doc_id", F.octet_length("data").cast("long").alias("n"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".czip").otherwise(".txt"))
    return rows.select(
        "doc_id",
        human_size(F.col("n")).alias("as_is"),
        human_size(F.col("n") * 1_000_000).alias("scaled"),
        ratio_text(F.col("n") / 8192).alias("share"),
        output_name(path, F.lit(False), F.lit("crar")).alias("packed_name"),
        output_name(path, F.lit(True), F.lit("crar")).alias("restored_name"),
    )


_NAMED = (
    content_types_and_savings, detect_documents, detect_pages, detect_distribution, chunk_plan_4k, byte_histogram, context_counts, crc32_documents,
    crc16_documents, crc32_combined_corpus, huffman_size, huffman_store_raw, archive_headers, archive_verify, archive_faults,
    archive_restore, packed_inputs, resume_equals_fresh, format_sizes,
)
QUERIES = {f.__name__: f for f in _NAMED} | {f"roundtrip_{m}": _roundtrip(m) for m in ("huffman", "lz77", "lzss_rnc", "lz77_only", "lzss_only", "rnc_only")}


# ---- SQL ------------------------------------------------------------------------------------------


def _crc32_table() -> list[int]:
    out = []
    for r in range(256):
        for _ in range(8):
            r = r >> 1 ^ (POLY32 if r & 1 else 0)
        out.append(r)
    return out


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"


def _crc32(text: str, data: str | None = None) -> str:
    table = "[" + ",".join(f"{x}::BIGINT" for x in _crc32_table()) + "]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data or _bytes(text)}), lambda a, x: xor(a >> 8, ({table})[(xor(a, x) & 255) + 1])), 4294967295::BIGINT)"


def _crc16(text: str) -> str:
    table = "[" + ",".join(f"{x}::BIGINT" for x in crc16_table()) + "]"
    return f"list_reduce(list_prepend(0::BIGINT, {_bytes(text)}), lambda a, x: xor((a * 256) & 65535, ({table})[xor(a >> 8, x) + 1]))"


# Fixed values, stated here again so that the library's own list is held against them: order, offset, bytes, type,
# description, extension, archive
_SIGNATURES = """
  (1, 0, '504B0304', 'application/zip', 'ZIP archive', '.zip', true),
  (2, 0, '526172211A07', 'application/x-rar', 'RAR archive', '.rar', true),
  (3, 0, '1F8B', 'application/gzip', 'GZIP archive', '.gz', true),
  (4, 0, '425A68', 'application/x-bzip2', 'BZIP2 archive', '.bz2', true),
  (5, 0, 'FD377A585A00', 'application/x-xz', 'XZ archive', '.xz', true),
  (6, 0, '377ABCAF271C', 'application/x-7z', '7-Zip archive', '.7z', true),
  (7, 0, '435A4950', 'application/x-czip', 'CZIP archive', '.czip', true),
  (8, 0, '43524152', 'application/x-crar', 'CRAR archive', '.crar', true),
  (9, 0, '89504E470D0A1A0A', 'image/png', 'PNG image', '.png', false),
  (10, 0, 'FFD8FF', 'image/jpeg', 'JPEG image', '.jpg', false),
  (11, 0, '47494638', 'image/gif', 'GIF image', '.gif', false),
  (12, 0, '424D', 'image/bmp', 'BMP image', '.bmp', false),
  (13, 0, '52494646', 'image/webp', 'WebP image', '.webp', false),
  (14, 0, '494433', 'audio/mpeg', 'MP3 audio', '.mp3', false),
  (15, 4, '66747970', 'video/mp4', 'MP4 video', '.mp4', false),
  (16, 0, '0000001866747970', 'video/mp4', 'MP4 video', '.mp4', false),
  (17, 0, '25504446', 'application/pdf', 'PDF document', '.pdf', false),
  (18, 0, 'D0CF11E0A1B11AE1', 'application/msword', 'Microsoft Office document', '.doc', false),
  (19, 0, '3C3F786D6C', 'text/xml', 'XML document', '.xml', false),
  (20, 0, '3C68746D6C', 'text/html', 'HTML document', '.html', false),
  (21, 0, '7F454C46', 'application/x-elf', 'ELF executable', '.elf', false),
  (22, 0, '4D5A', 'application/x-msdownload', 'Windows executable', '.exe', false),
  (23, 0, 'EFBBBF', 'text/plain', 'UTF-8 text with a mark', '.txt', false)"""


def _detect(key: str, table: str, text: str) -> str:
    head = "regexp_extract_all(substr(h, 1, 1024), '..')"
    return f"""
SELECT {key}, coalesce(s.mime, CASE WHEN t THEN 'text/plain' ELSE 'application/octet-stream' END) AS mime,
  coalesce(s.description, CASE WHEN t THEN 'Text' ELSE 'Binary data' END) AS description,
  coalesce(s.extension, CASE WHEN t THEN '.txt' ELSE '.bin' END) AS extension,
  s IS NULL AND t AS is_text, coalesce(s.archive, false) AS is_archive
FROM (
  SELECT h.{key}, h.n, any_value(t) AS t, arg_min({{'mime': mime, 'description': description, 'extension': extension, 'archive': archive}}, rank) FILTER (substr(h, 2 * place + 1, length(sig)) = sig) AS s
  FROM (SELECT *, (len(list_filter({head}, lambda b: b = '00')) = 0
      AND len(list_filter({head}, lambda b: (b BETWEEN '01' AND '08') OR (b BETWEEN '0E' AND '1F'))) < len({head}) // 20) AS t
    FROM (SELECT {key}, row_number() OVER () AS n, hex(encode({text}))[:1024] AS h FROM {table})) h, (VALUES {_SIGNATURES}) sigs(rank, place, sig, mime, description, extension, archive)
  GROUP BY h.{key}, h.n)"""


_FOUR_K = """
SELECT doc_id, i AS chunk_idx, substr(h, 8192 * i + 1, 8192) AS piece
FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(generate_series(0, (octet_length(encode(text)) - 1) // 4096)) AS i FROM documents WHERE text <> '')
"""
_PIECE_BYTES = "list_transform(regexp_extract_all(piece, '..'), lambda h: ('0x' || h)::BIGINT)"


def _bits(keys: str, source: str, data: str) -> str:
    """Bits of an optimal code for each row of ``source``, merging the two least counts again and again."""
    return f"""
WITH RECURSIVE counts AS (
  SELECT {keys}, b, count(*) AS n FROM (SELECT {keys}, unnest({data}) AS b FROM {source}) GROUP BY ALL),
merged AS (
  SELECT {keys}, list_sort(list(n)) AS l, CASE WHEN count(*) = 1 THEN any_value(n) ELSE 0 END::BIGINT AS bits FROM counts GROUP BY {keys}
  UNION ALL
  SELECT {keys}, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM merged WHERE len(l) > 1),
coded AS (SELECT {keys}, 265 + ceil(bits / 8)::BIGINT AS coded_bytes FROM merged WHERE len(l) = 1)"""


_SIZED = f"""{_bits("doc_id", "documents", _bytes("text"))},
sized AS (
  SELECT doc_id, octet_length(encode(text)) AS n_bytes, coalesce(coded_bytes, 265) AS coded_bytes FROM documents LEFT JOIN coded USING (doc_id))
"""
_DIGEST = "SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(encode(text)) AS digest FROM documents"
_HUMAN = lambda n: (
    f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {n} // 1024 || ' KB' WHEN {n} < 1073741824 THEN {n} // 1048576 || ' MB' ELSE format('{{:.1f}} GB', {n} / 1073741824) END"
)
_PATH = "('docs/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.czip' ELSE '.txt' END)"

SQL = {
    "content_types_and_savings": f"""{_bits("doc_id, chunk_idx", f"({_FOUR_K})", _PIECE_BYTES)},
sizes AS (
  SELECT doc_id, count(*) AS chunks, sum(len(piece) // 2)::BIGINT AS orig_bytes, sum(least(len(piece) // 2, coded_bytes))::BIGINT AS packed_bytes,
    sum((coded_bytes >= len(piece) // 2)::INT)::BIGINT AS stored_raw
  FROM ({_FOUR_K}) JOIN coded USING (doc_id, chunk_idx) GROUP BY doc_id)
SELECT doc_id, t.mime, {_crc32("text")} AS crc32, chunks, orig_bytes, packed_bytes, stored_raw
FROM sizes JOIN documents USING (doc_id) JOIN ({_detect("doc_id", "documents", "text")}) t USING (doc_id)""",
    "resume_equals_fresh": f"""
SELECT doc_id, count(*) AS chunks, sum(len(piece) // 2)::BIGINT AS orig_bytes, bit_xor({_crc32("", _PIECE_BYTES)}) AS mark FROM ({_FOUR_K}) GROUP BY doc_id""",
    "detect_documents": _detect("doc_id", "documents", "text"),
    "detect_pages": _detect("page_id", "pages", "html"),
    "detect_distribution": f"SELECT mime, is_text, count(*) AS n FROM ({_detect('doc_id', 'documents', 'text')}) GROUP BY ALL",
    "chunk_plan_4k": f"SELECT doc_id, chunk_idx, len(piece) // 2 AS n_bytes, md5(unhex(piece)) AS digest FROM ({_FOUR_K})",
    "byte_histogram": f"SELECT byte, count(*) AS n FROM (SELECT unnest({_bytes('text')}) AS byte FROM documents) GROUP BY ALL",
    "context_counts": f"""
WITH b AS (SELECT {_bytes("text")} AS l FROM documents WHERE octet_length(encode(text)) > 1),
pairs AS (SELECT unnest(l[:-2]) AS prev, unnest(l[2:]) AS byte FROM b),
counts AS (SELECT prev, byte, count(*) AS n FROM pairs GROUP BY ALL)
SELECT prev, byte, n, coalesce(sum(n) OVER (PARTITION BY prev ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM counts""",
    "crc32_documents": f"SELECT doc_id, crc32, lpad(hex(crc32), 8, '0') AS crc_hex FROM (SELECT doc_id, {_crc32('text')} AS crc32 FROM documents)",
    "crc16_documents": f"SELECT doc_id, {_crc16('text')} AS crc16 FROM documents",
    "crc32_combined_corpus": f"""
SELECT source, {_crc32("t")} AS crc32, n AS parts FROM (SELECT source, string_agg(text, '' ORDER BY doc_id) AS t, count(*) AS n FROM documents GROUP BY source)""",
    "huffman_size": f"{_SIZED} SELECT doc_id, n_bytes, coded_bytes FROM sized",
    "huffman_store_raw": f"{_SIZED} SELECT doc_id, n_bytes AS orig_sz, least(n_bytes, coded_bytes) AS csz, coded_bytes >= n_bytes AS raw FROM sized",
    "archive_headers": f"""
SELECT doc_id::VARCHAR AS name, 'CZIP' AS container, 0 AS method, octet_length(encode(text)) AS size, {_crc32("text")} AS crc32,
  (octet_length(encode(text)) + 4095) // 4096 AS n_chunks FROM documents WHERE text <> ''""",
    "archive_verify": """
SELECT doc_id::VARCHAR AS path, octet_length(encode(text)) AS size, (octet_length(encode(text)) + 4095) // 4096 AS chunks, 'ok' AS status FROM documents WHERE text <> ''""",
    "archive_faults": """
SELECT doc_id::VARCHAR AS path, ['ok', 'magic', 'version', 'method', 'size', 'crc', 'chunks', 'cut off'][doc_id % 8 + 1] AS status FROM documents WHERE text <> ''""",
    "archive_restore": f"SELECT doc_id, chunk_idx, len(piece) // 2 AS n_bytes, md5(unhex(piece)) AS digest FROM ({_FOUR_K})",
    "packed_inputs": """
SELECT doc_id, false AS packed, NULL::VARCHAR AS warning FROM documents
UNION ALL SELECT doc_id, true, 'already packed: CZIP archive' FROM documents WHERE text <> ''""",
    "format_sizes": f"""
SELECT doc_id, {_HUMAN("n")} AS as_is, {_HUMAN("(n * 1000000)")} AS scaled, format('{{:.1f}}%', n / 8192 * 100) AS share, {_PATH} || '.crar' AS packed_name,
  CASE WHEN doc_id % 2 = 0 THEN 'docs/' || doc_id ELSE {_PATH} || '_restored' END AS restored_name
FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)""",
} | {name: _DIGEST for name in QUERIES if name.startswith("roundtrip_")}
