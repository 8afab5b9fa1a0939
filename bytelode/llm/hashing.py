"""Word hashes of whole batches of text at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd 64-bit base for polynomials modulo 2**64, and the constants of the splitmix64 finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.cumprod(np.full(256, BASE), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, BASE), dtype=np.uint64)
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of all texts in order,
    and where each text's words begin (one entry more than texts)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    joined = np.frombuffer(b" ".join(raw).lower() + b" ", np.uint8)
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    space = _SPACE[joined]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    begins = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), begins
    place = np.arange(len(joined), dtype=np.int64)
    place -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(joined)]))))
    value = joined.astype(np.uint64) + np.uint64(1)
    value[space] = 0
    value *= powers(int(place[~space].max()) + 1)[np.where(space, 0, place)]
    return mixed(np.add.reduceat(value, starts)), begins


def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, a longer text alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[str | None], width: int = 2) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashed shingles of ``width`` words; a text with fewer words
    has them all as one shingle, one without words none."""
    for lo, hi in slices(texts):
        words, begins = word_hashes(texts[lo:hi])
        grams = words.copy()
        for k in range(1, width):
            grams[: len(words) - k] = mixed(grams[: len(words) - k] * MIX2 + words[k:] + np.uint64(k))
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                short = words[a:b]
                value = np.uint64(b - a)
                for w in short:
                    value = mixed(np.array([value]) * MIX1 + w)[0]
                yield np.array([value])
            else:
                yield words[:0]
