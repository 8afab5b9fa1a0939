"""Display strings, output names and big-endian integers as column expressions."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names of methods and containers
METHODS = {"huffman": 0, "lz77": 1, "lzss_rnc": 2}
METHOD_NAMES = {"huffman": "Huffman", "lz77": "LZ77 + Huffman", "lzss_rnc": "LZSS + RNC"}
FORMATS = {"czip": "CZIP", "crar": "CRAR"}
#: Containers and the methods they may hold.
ALLOWED = {"czip": ("huffman", "lz77"), "crar": ("lzss_rnc",)}


def one_decimal(x: Column) -> Column:
    """``x``, a double, with one decimal, as C's ``%.1f`` has it: its exact value is rounded, and ties, which only .25 and .75
    can be, go to the even digit.  Java's rounds the shortest decimal form, and ties up."""

    def reached(k: int) -> Column:
        """Whether the rest rounds to more than k tenths: a double against a bound that may lie beside the nearest double."""
        edge, near = Fraction(2 * k + 1, 20), Fraction((2 * k + 1) / 20)
        up = near > edge or near == edge and k % 2
        return (rest >= (2 * k + 1) / 20 if up else rest > (2 * k + 1) / 20).cast("long")

    size = F.abs(x)
    whole = F.floor(size)
    rest = size - whole
    tenths = whole * 10 + reduce(add, (reached(k) for k in range(10)))
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(size < 1 << 53, text).otherwise(F.format_string("%.1f", x))  # beyond, doubles are whole


def human_size(n: Column) -> Column:
    """Whole B, KB or MB, cut off, and GB with one decimal."""
    part = lambda k, unit: F.concat(F.floor(n / 1024**k).cast("string"), F.lit(f" {unit}"))
    return (
        F.when(n < 1024, part(0, "B"))
        .when(n < 1024**2, part(1, "KB"))
        .when(n < 1024**3, part(2, "MB"))
        .otherwise(F.concat(one_decimal(n / 1024**3), F.lit(" GB")))
    )


def ratio_text(share: Column) -> Column:
    return F.concat(one_decimal(share * 100), F.lit("%"))


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[value]


def method_name(method: Column) -> Column:
    return _named(method, METHOD_NAMES)


def format_name(container: Column) -> Column:
    return _named(container, FORMATS)


def output_name(path: Column, restore: Column, container: Column) -> Column:
    """Packing appends the container's suffix; restoring takes it off, or else says so."""
    cut = F.when((F.length(path) > 5) & path.rlike(r"\.(czip|crar)$"), F.regexp_replace(path, r"\.(czip|crar)$", ""))
    return F.when(restore, F.coalesce(cut, F.concat(path, F.lit("_restored")))).otherwise(F.concat(path, F.lit("."), container))


def big_endian(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def read_big_endian(content: Column, offset: int, width: int) -> Column:
    """The integer at ``offset``; null where bytes are missing."""
    cut = F.substring(content, offset + 1, width)
    return F.when(F.length(cut) == width, F.conv(F.hex(cut), 16, 10).cast("decimal(20,0)").cast("long"))
