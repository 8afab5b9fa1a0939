"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A passage counts as leaked if it lies within ``k`` edits of a test item, ``k`` being ``error_rate``
of the item's length.  The item is halved again and again, its errors shared out, until ``k + 1``
pieces with no errors left remain: one of them must occur exactly.  All pieces of a block of items
are sought in one pass over each whole text; a hit is verified from its piece up through the halves
that hold it, each by Myers' bit-parallel distance with its own share of errors, so chance hits end
at the first step.

Items are taken in blocks of bounded size, each against all documents; no row is shuffled.

Items shorter than ``shortest`` normalised characters have no errors to spare: they are sought as they are, between word bounds.

Nulls: a null or empty text or item, or a table without rows, matches nothing; null ids are carried.  Equal items match under
each of their ids, repeated documents give repeated rows.  Case and everything but letters and
digits are ignored (runs of other characters count as one space)."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


class Node(NamedTuple):
    """A stretch of an item, the errors allowed in it and the stretch it is a half of."""

    lo: int
    hi: int
    errors: int
    parent: Node | None


def leaves(lo: int, hi: int, errors: int, parent: Node | None = None) -> list[Node]:
    """If the stretch has at most ``errors`` edits, a leaf has none (or is as long as its share)."""
    node = Node(lo, hi, errors, parent)
    if errors == 0:
        return [node]
    left = (errors - 1) // 2
    right = errors - 1 - left
    mid = lo + max(1, round((hi - lo) * (left + 1) / (errors + 1)))
    return leaves(lo, mid, left, node) + leaves(mid, hi, right, node)


def near_tests(item: str, leaf: Node) -> list[tuple[str, int, int]]:
    """What must also be seen near an exact leaf if its parent holds: the parent's other half, cut
    into one piece more than the errors left, has a piece unchanged, moved by those errors at most.
    Each test is a piece and where it may lie, counted from the leaf's start."""
    up = leaf.parent
    if up is None:
        return []
    lo, hi = (leaf.hi, up.hi) if leaf.lo == up.lo else (up.lo, leaf.lo)
    marks = [lo + (hi - lo) * i // (up.errors + 1) for i in range(up.errors + 2)]
    return [(item[a:b], a - leaf.lo - up.errors, b - leaf.lo + up.errors) for a, b in zip(marks, marks[1:])]


def best_end(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Smallest distance of ``pattern`` to any substring of ``text`` and where that ends; Myers."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


class Items:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple], error_rate: float, shortest: int):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        at: dict[str, list[tuple[int, Node, list]]] = {}
        self.short = [len(t) < shortest for _, t in self.items]
        self.budget = [0 if short else int(error_rate * len(t)) for short, (_, t) in zip(self.short, self.items)]
        for n, (_, t) in enumerate(self.items):
            for leaf in leaves(0, len(t), self.budget[n]):
                at.setdefault(t[leaf.lo : leaf.hi], []).append((n, leaf, near_tests(t, leaf)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def find(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item number, least distance, passages) of the items near to some passage of the text."""
        text = normal(raw)
        found: dict[int, tuple[int, int, int]] = {}
        if self.empty or not text:
            return []
        for last, (size, uses) in self.automaton.iter(text):
            start = last + 1 - size
            for n, node, tests in uses:
                if self.short[n] and (text[start - 1 : start] > " " or text[last + 1 : last + 2] > " "):
                    continue
                for piece, a, b in tests:
                    if text.find(piece, max(0, start + a), max(0, start + b)) >= 0:
                        break
                else:
                    if tests:
                        continue
                known = found.get(n)
                if known and last < known[2]:  # inside a passage that is already found
                    continue
                item = self.items[n][1]
                at = node.lo
                distance, end = 0, last + 1
                up = node.parent
                while up is not None:
                    left = max(0, start - (at - up.lo) - up.errors)
                    right = start + (up.hi - at) + up.errors
                    distance, end = best_end(item[up.lo : up.hi], text[left:right], up.errors)
                    if distance > up.errors:
                        break
                    end += left
                    up = up.parent
                else:
                    best, times, _ = known or (distance, 0, 0)
                    found[n] = (min(best, distance), times + 1, end)
        return [(n, distance, times) for n, (distance, times, _) in found.items()]


def leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.1, shortest: int = 30) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, distance, n_passages,
    item_chars.  Items shorter than ``shortest`` normalised characters are found only without any edit."""
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, n_passages int, item_chars int"
    item_kind = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
    out = None
    for b in range(blocks):
        rows = items.where(F.col("text").isNotNull() & (block == b)).select("item_id", "text").collect()
        part = docs.select("doc_id", "text").mapInArrow(
            _searcher([tuple(r) for r in rows], error_rate, shortest, item_kind), schema
        )
        out = part if out is None else out.unionByName(part)
    return out


def _searcher(rows: list[tuple], error_rate: float, shortest: int, item_kind: pa.DataType):
    def run(batches):
        block = Items(rows, error_rate, shortest)
        for batch in batches:
            own, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, distance, times in block.find(text):
                    own.append(i)
                    hits.append((block.items[n][0], distance, times, len(block.items[n][1])))
            ids, *rest = zip(*hits) if hits else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array(ids, item_kind), *(pa.array(x, pa.int32()) for x in rest)],
                names=["doc_id", "item_id", "distance", "n_passages", "item_chars"],
            )

    return run
