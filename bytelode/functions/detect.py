"""Content types from signatures and a text test, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures in the order they are tried: bytes in hex, offset, type, description, extension
SIGNATURES = [
    ("504B0304", 0, "application/zip", "ZIP archive", ".zip"),
    ("526172211A07", 0, "application/x-rar", "RAR archive", ".rar"),
    ("1F8B", 0, "application/gzip", "GZIP archive", ".gz"),
    ("425A68", 0, "application/x-bzip2", "BZIP2 archive", ".bz2"),
    ("FD377A585A00", 0, "application/x-xz", "XZ archive", ".xz"),
    ("377ABCAF271C", 0, "application/x-7z", "7-Zip archive", ".7z"),
    ("435A4950", 0, "application/x-czip", "CZIP archive", ".czip"),
    ("43524152", 0, "application/x-crar", "CRAR archive", ".crar"),
    ("89504E470D0A1A0A", 0, "image/png", "PNG image", ".png"),
    ("FFD8FF", 0, "image/jpeg", "JPEG image", ".jpg"),
    ("47494638", 0, "image/gif", "GIF image", ".gif"),
    ("424D", 0, "image/bmp", "BMP image", ".bmp"),
    ("52494646", 0, "image/webp", "WebP image", ".webp"),
    ("494433", 0, "audio/mpeg", "MP3 audio", ".mp3"),
    ("66747970", 4, "video/mp4", "MP4 video", ".mp4"),
    ("0000001866747970", 0, "video/mp4", "MP4 video", ".mp4"),
    ("25504446", 0, "application/pdf", "PDF document", ".pdf"),
    ("D0CF11E0A1B11AE1", 0, "application/msword", "Microsoft Office document", ".doc"),
    ("3C3F786D6C", 0, "text/xml", "XML document", ".xml"),
    ("3C68746D6C", 0, "text/html", "HTML document", ".html"),
    ("7F454C46", 0, "application/x-elf", "ELF executable", ".elf"),
    ("4D5A", 0, "application/x-msdownload", "Windows executable", ".exe"),
    ("EFBBBF", 0, "text/plain", "UTF-8 text with a mark", ".txt"),
]
ARCHIVES = "zip|rar|gzip|bzip2|czip|crar|7z|xz"
TEXT = ("text/plain", "Text", ".txt")
OTHER = ("application/octet-stream", "Binary data", ".bin")
HEAD = 512


def looks_like_text(content: Column) -> Column:
    """No zero byte among the first 512, and less than a twentieth of them are control bytes other
    than white space (so nothing under 20 bytes is text)."""
    head = F.substring(content, 1, HEAD)
    chars = F.decode(head, "ISO-8859-1")
    controls = F.length(F.regexp_replace(chars, r"[^\x01-\x08\x0E-\x1F]", ""))
    return ~F.contains(chars, F.lit("\x00")) & (controls < F.floor(F.length(chars) / 20))


def detect(content: Column) -> Column:
    """struct of mime, description, extension, is_text, is_archive; null content counts as empty."""
    content = F.coalesce(content, F.lit(b""))
    text = looks_like_text(content)
    pick = lambda k: _first(content, text, k)
    signed = _any(content)
    return F.struct(
        pick(2).alias("mime"),
        pick(3).alias("description"),
        pick(4).alias("extension"),
        (~signed & text).alias("is_text"),
        (signed & pick(2).rlike(ARCHIVES)).alias("is_archive"),
    )


def packed_warning(content: Column) -> Column:
    """What packing input that is an archive already is warned of with, judged by its first 16 bytes; else null."""
    found = detect(F.substring(F.coalesce(content, F.lit(b"")), 1, 16))
    return F.when(found["is_archive"], F.concat(F.lit("already packed: "), found["description"]))


def _matches(content: Column, row: tuple) -> Column:
    return F.substring(content, row[1] + 1, len(row[0]) // 2) == F.lit(bytes.fromhex(row[0]))


def _any(content: Column) -> Column:
    out = F.lit(False)
    for row in SIGNATURES:
        out |= _matches(content, row)
    return out


def _first(content: Column, text: Column, k: int) -> Column:
    out = F.when(_matches(content, SIGNATURES[0]), SIGNATURES[0][k])
    for row in SIGNATURES[1:]:
        out = out.when(_matches(content, row), row[k])
    return out.when(text, TEXT[k - 2]).otherwise(OTHER[k - 2])
