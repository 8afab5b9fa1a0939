"""Matches, tokens and bits of many values at once, in numpy; memory follows PART, not the values' sizes times a word.

Values lie one behind the other in one array of bytes; ``starts`` and ``ends`` say where.  A token is a literal (distance 0 and
the byte) or a reference (distance and length)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Places that are worked on at once, and values that are encoded at once.
PART, MANY = 1 << 17, 256


def ranges(sizes: Sequence[int], most: int, many: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of ``most`` bytes together and ``many`` at most; a longer one is alone."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and (total + size > most or i - lo == many):
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(values: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    return ranges([len(v) for v in values], PART, MANY)


def joined(values: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data, starts, ends of the values."""
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.append(0, ends)[: len(values)], ends


def words(data: np.ndarray, order: str) -> np.ndarray:
    """Eight bytes from each place on as a number, zeros behind the end."""
    return np.ndarray((len(data),), f"{order}u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,)).astype(np.uint64)


def path(n: int, steps: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """The places before ``n`` that are reached from 0, going on from each by its step; ``steps(lo, hi)`` has those from lo to hi."""
    out, at = [np.zeros(0, np.int64)], 0
    while at < n:
        lo, m = at, min(PART, n - at)
        step = steps(lo, lo + m)
        one = np.append(np.minimum(np.arange(m) + step, m), m)
        far = one
        for _ in range(4):
            far = far.take(far)
        firsts, p = [], 0
        while p < m:
            firsts.append(p)
            p = far.item(p)
        rows = [np.array(firsts)]
        for _ in range(15):
            rows.append(one.take(rows[-1]))
        places = np.stack(rows, 1).ravel()
        places = places[places < m]
        out.append(places + lo)
        at = int(lo + places[-1] + step[places[-1]])
    return np.concatenate(out)


def _same(x: np.ndarray) -> np.ndarray:
    """How many low bytes of each number are zero."""
    return np.bitwise_count((x - np.uint64(1)) & ~x) >> 3


def nearest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, longest: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, length) at every place: the nearest of the longest matches of three bytes or more among the last ``chain`` places
    of the same three bytes in the window, else zeros.

    Sorted by value, three bytes and place, the c-th last such place stands c before."""
    n, word = len(data), words(data, "<")
    distance, length = np.zeros(n, np.int32), np.zeros(n, np.int32)
    of = np.repeat(np.arange(len(ends)), ends - starts)
    for lo in range(0, n, PART):
        hi, base = min(lo + PART, n), max(0, lo - window)
        at = np.arange(base, hi)
        at = at[at + 3 <= ends[of[base:hi]]]
        bits = (hi - base).bit_length()
        three = (word[at] & np.uint64(0xFFFFFF)).astype(np.int64)
        at = (np.sort(((of[at] - of[base] << 24) + three << bits) + at - base) & (1 << bits) - 1) + base
        least, limit = np.maximum(at - window, starts[of[at]]), np.minimum(longest, ends[of[at]] - at)
        own, best, back = word[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for c in range(1, min(chain, len(at) - 1) + 1):
            x = own[c:] ^ own[:-c]
            inside = at[:-c] >= least[c:]
            k = np.minimum(_same(x), limit[c:])
            more = np.flatnonzero((x == 0) & inside & (best[c:] < limit[c:]) & (limit[c:] > 8))
            if len(more):
                k[more] = _common(word, at[c:][more], at[:-c][more], limit[c:][more])
            better = inside & (k > best[c:])
            np.copyto(best[c:], k, where=better)
            np.copyto(back[c:], at[c:] - at[:-c], where=better)
        found = (best >= 3) & (at >= lo)
        distance[at[found]], length[at[found]] = back[found], best[found]
    return distance, length


def _common(word: np.ndarray, p: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Lengths, up to the limits, of what is the same from p and from q on; the first eight bytes are."""
    k, left = np.full(len(p), 8), np.arange(len(p))
    while len(left):
        more = _same(word[p[left] + k[left]] ^ word[q[left] + k[left]])
        k[left] += more
        left = left[(more == 8) & (k[left] < limit[left])]
    return np.minimum(k, limit)


def oldest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, length) at every place: the farthest, at most ``block`` back, of the longest matches of two bytes or more that
    end within the place's block of its value, else zeros.

    Places of the same bytes are parted by one byte more again and again; those with no other near them go."""
    n = len(data)
    distance, length = np.zeros(n, np.int32), np.zeros(n, np.int32)
    of = np.repeat(np.arange(len(ends)), ends - starts)
    for lo in range(0, n, PART):
        hi, base = min(lo + PART, n), max(0, lo - block)
        bits = (hi - base).bit_length()
        at = np.arange(base, hi)
        first, end = starts[of[base:hi]], ends[of[base:hi]]
        room = np.minimum(first + ((at - first) // block + 1) * block, end) - at
        at = at[at + 2 <= end]
        key = ((of[at] - of[base] << 16) + (data[at].astype(np.int64) << 8) + data[at + 1] << bits) + at - base
        reach, far = np.zeros(hi - base, np.int32), np.zeros(hi - base, np.int32)
        for size in range(2, longest + 1):
            key = np.sort(key)
            group, own = key >> bits, key & (1 << bits) - 1
            new = np.append(True, group[1:] != group[:-1])
            near = np.append(False, ~new[1:] & (own[1:] - own[:-1] <= block))
            hits = np.flatnonzero(near & (room[own] >= size))
            if len(hits):
                reach[own[hits]] = size
                least = np.searchsorted(key, (group[hits] << bits) + np.maximum(own[hits] - block, 0))
                far[own[hits]] = own[hits] - own[least]
            keep = (near | np.append(near[1:], False)) & (own + base + size < end[own])
            if not keep.any():
                break
            own, group = own[keep], np.cumsum(new)[keep]
            key = ((group << 8) + data[own + base + size] << bits) + own
        distance[lo:hi], length[lo:hi] = far[lo - base :], reach[lo - base :]
    return distance, length


def parsed(data: np.ndarray, distance: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance, literal or length) of the tokens that the matches at every place make from left to right."""
    at = path(len(data), lambda lo, hi: np.maximum(length[lo:hi], 1))
    back = distance[at]
    return at, back, np.where(back > 0, length[at], data[at])


def expanded(distance: np.ndarray, value: np.ndarray, size: int) -> bytes:
    """What tokens stand for, until there are ``size`` bytes; ``ValueError`` if it is less or more, or a reference goes too far back."""
    ends = np.cumsum(np.where(distance > 0, value, 1))
    used = int(np.searchsorted(ends, size)) + 1 if size else 0
    if size and (used > len(ends) or ends[used - 1] != size):
        raise ValueError("size does not match")
    out, distance, value, ends = np.zeros(size, np.uint8), distance[:used], value[:used], ends[:used]
    lengths = np.where(distance > 0, value, 1)
    if (distance > ends - lengths).any():
        raise ValueError("reference before the start")
    plain = distance == 0
    out[(ends - 1)[plain]] = value[plain]
    i = 0
    while i < used:  # within a part, places are followed back to literals or to what is done
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART)))
        lo, hi = int(ends[i] - lengths[i]), int(ends[j - 1])
        source = np.arange(lo, hi) - np.repeat(distance[i:j], lengths[i:j])
        while True:
            before = np.where(source >= lo, source.take(np.maximum(source - lo, 0)), source)
            if (before == source).all():
                break
            source = before
        out[lo:hi] = out[source]
        i = j
    return out.tobytes()


def bit_strings(codes: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, int]]:
    """The codes of each value, of 1 to 63 bits, put together, and how many bits pad the last byte; ``counts`` has the codes of each."""
    total = np.append(0, np.cumsum(widths))
    lasts = np.cumsum(counts)
    bits = total[lasts] - total[lasts - counts]
    first = np.append(0, np.cumsum(-(-bits // 64)))
    at = total[:-1] + np.repeat(64 * first[:-1] - total[lasts - counts], counts)
    out = np.zeros(first[-1] + 1, np.uint64)
    word, over = at >> 6, (at & 63) + widths - 64
    if len(codes):
        codes = codes.astype(np.uint64)
        head = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[heads]] = np.bitwise_or.reduceat(head, heads)
        rest = np.flatnonzero(over > 0)
        out[word[rest] + 1] |= codes[rest] << (64 - over[rest]).astype(np.uint64)
    whole = out.astype(">u8").tobytes()
    return [(whole[8 * f : 8 * f + (b + 7) // 8], -b % 8) for f, b in zip(first.tolist(), bits.tolist())]


def grouped(distance: np.ndarray, value: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bytes of the tokens of each block: a control byte before each eight, then a byte for a literal, two for a reference, whose
    ``value`` is what they hold.  ``counts`` has the tokens of each block, none is empty."""
    if not len(counts):
        return []
    lasts = np.cumsum(counts)
    rank = np.arange(len(value)) - np.repeat(lasts - counts, counts) & 7
    pair, lead = distance > 0, rank == 0
    ends = np.cumsum(1 + pair + lead)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - 1] = value & 255
    out[(ends - 2)[pair]] = value[pair] >> 8
    heads = np.flatnonzero(lead)
    out[ends[heads] - 2 - pair[heads]] = np.add.reduceat(np.where(pair, 0x80 >> rank, 0), heads)
    whole, bounds = out.tobytes(), [0, *ends[lasts - 1].tolist()]
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


def ungrouped(data: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance of 1 if it is a reference, value) of the tokens of groups whose control bytes are at ``groups``; those beyond the end
    too, as if zeros stood there."""
    pair = data[groups][:, None] >> np.arange(7, -1, -1) & 1
    at = (groups[:, None] + 1 + np.arange(8) + np.cumsum(pair, 1) - pair).ravel()
    pair = pair.ravel().astype(np.int64)
    more = np.append(data, np.zeros(18, np.uint8)).astype(np.int64)
    return at, pair, np.where(pair > 0, (more[at] << 8) + more[at + 1], more[at])
