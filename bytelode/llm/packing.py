"""Best-fit packing with large-item matching (operator 10).

A task tokenises documents and numbers its pieces within each length.  Only the histogram of
lengths, at most ``capacity`` rows however large the corpus, reaches the driver; there the packing is
solved in counts: so many bins of this pattern.  A piece finds its bin from its length and its rank
among the pieces of that length, so the pieces never meet in one place.

Pieces over a third of the capacity fit at most twice into a bin: the longest is matched with the
longest that fits beside it.  Shorter pieces, longest first, take the tightest gap that holds them.

Nulls: a null text is empty and packs as the end mark alone; null ``doc_id`` is kept.  Repeated rows
are separate documents.  An empty table gives no rows."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

END = b"\x01\x00\x00\x00"
CACHE_WORDS, CACHE_RUNS = 1_000_000, 600_000
_encoders: dict[str, WordEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the
    others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordEncoder:
    """Token ids of white-space separated words, kept from task to task.

    The vocabulary drops white space and never merges across it, so a text's ids are its words' ids
    in order.  Words fall into runs of letters, single digits and other runs, each of which the
    tokenizer's model encodes alone, so "then," and "Then" share "then".  Words with apostrophes
    (contractions), "<|" (special tokens), capital sigma (lower case by context) or uncomposed
    accents go through the whole tokenizer."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def run(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            if len(self.parts) >= CACHE_RUNS:
                self.parts.clear()
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            known = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return known

    def word(self, raw: bytes) -> bytes:
        w = raw.decode()
        if "'" in w or "<|" in w or "Σ" in w or not (w.isascii() or unicodedata.is_normalized("NFC", w)):
            ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            return np.asarray(ids, "<u4").tobytes()
        return b"".join(map(self.run, self.runs.findall(w.lower())))

    def ids(self, text: str | None) -> bytes:
        words = text.encode("utf-8", "replace").split() if text else []
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words)) + END
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.word(w)
            out.append(ids)
        return b"".join(out) + END


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, numbered within their task and length (part, nth)."""

    def run(batches):
        encoder, part, seen = _encoder(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                cut = batch.slice(lo, 1000)
                own, piece, start, length, crc, nth = [], [], [], [], [], []
                for i, text in enumerate(cut.column(1).to_pylist()):
                    ids = encoder.ids(text)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part_ids = ids[at : at + 4 * capacity]
                        n = len(part_ids) // 4
                        own.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(part_ids))
                        nth.append(seen[n])
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column(0).take(pa.array(own, pa.int64())),
                        pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                        pa.array([part] * len(own), pa.int32()),
                        pa.array(nth, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind=kind))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(pattern, bins) pairs; a pattern lists (length, how often).  All work is in counts, so it
    depends on the capacity and not on the number of pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside it
        if at < 0:
            gaps[capacity - n].append(([(n, 1)], left[n]))
            large.pop()
            continue
        p = large[at]
        if p == n:
            bins, rest = divmod(left[n], 2)
            if bins:
                gaps[capacity - 2 * n].append(([(n, 2)], bins))
            left[n] = rest
            if rest:
                if at:
                    p = large[at - 1]
                else:
                    gaps[capacity - n].append(([(n, 1)], 1))
                    left[n] = 0
            if not left[n]:
                large.pop()
                continue
        bins = min(left[n], left[p])
        gaps[capacity - n - p].append(([(n, 1), (p, 1)], bins))
        for x in (n, p):
            left[x] -= bins
            if not left[x]:
                large.pop(bisect_left(large, x))
    order = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(order, n)
            if at == len(order):
                gap, pattern, bins = capacity, [], todo  # as many fresh bins as it takes
            else:
                gap = order[at]
                pattern, bins = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            fit = gap // n
            full = min(bins, todo // fit)
            made = [(fit, full)] if full else []
            todo -= full * fit
            if todo < fit and todo and full < bins:
                made.append((todo, 1))
                todo = 0
            used = sum(b for _, b in made)
            if pattern and bins > used:
                made.append((0, bins - used))
            for k, b in made:
                rest = gap - k * n
                if not gaps[rest]:
                    insort(order, rest)
                gaps[rest].append((pattern + [(n, k)] * (k > 0), b))
    return [x for gap in sorted(gaps) for x in gaps[gap]]


def plan_slots(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: which bins they go to and where in them."""
    rank, base, rows = defaultdict(int), 0, []
    for pattern, count in bins:
        at = 0
        for n, k in pattern:
            rows.append((n, rank[n], base, k, at))
            rank[n] += k * count
            at += n * k
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "base": table[:, 2], "times": table[:, 3], "at": table[:, 4]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    made = staged(pieces(docs, tokenizer_path, capacity), "pieces")
    per_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_slots(plan_bins(counts, capacity))

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(slots["key"], (length << 44) + rank, "right") - 1
            nth, times = rank - slots["first"][k], slots["times"][k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(slots["base"][k] + nth // times), pa.array(slots["at"][k] + nth % times * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked = made.join(firsts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
