"""Chunk codecs as vectorised column functions.

Each codec turns chunks of bytes into others and back; chunks are independent, so Spark deals them to tasks.  Encoders
take many at once, decoders one.  Decoders check what they read and raise ``ValueError``."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from .checksums import crc16_of_all
from .tokens import bit_strings, expanded, grouped, joined, nearest, oldest, parsed, path, ranges, slices, ungrouped, words

MOST_BYTES = 1 << 28


def _size(data: bytes, at: int, width: int) -> int:
    n = int.from_bytes(data[at : at + width], "big")
    if n > MOST_BYTES:
        raise ValueError("implausible size")
    return n


# ---- Huffman: 256 code lengths, size (8 bytes), padding (1 byte), bits -------------------------


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Optimal code lengths; ties go to the older node, leaves being oldest in order of symbols."""
    symbols = sorted(counts)
    if len(symbols) == 1:
        return {symbols[0]: 1}
    heap = [counts[s] << 9 | i for i, s in enumerate(symbols)]
    heapq.heapify(heap)
    above = [0] * (2 * len(symbols))
    for node in range(len(symbols), 2 * len(symbols) - 1):
        a, b = heapq.heappop(heap), heap[0]
        heapq.heapreplace(heap, (a >> 9) + (b >> 9) << 9 | node)
        above[a & 511] = above[b & 511] = node
    depth = [0] * len(above)
    for node in range(2 * len(symbols) - 3, -1, -1):
        depth[node] = depth[above[node]] + 1
    return dict(zip(symbols, depth))


def canonical_codes(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code) in order of the codes."""
    codes, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        if code >> n:
            raise ValueError("code lengths are over-subscribed")
        codes.append((s, n, code))
        code, last = code + 1, n
    return codes


def huffman_encode_all(values: Sequence[bytes]) -> list[bytes]:
    out = []
    for lo, hi in slices(values):
        data, starts, ends = joined(values[lo:hi])
        sizes = ends - starts
        places = data + np.repeat(np.arange(0, 256 * len(sizes), 256), sizes)
        counts = np.bincount(places, minlength=256 * len(sizes)).reshape(-1, 256)
        widths, codes = np.zeros(counts.shape, np.uint8), np.zeros(counts.shape, np.uint64)
        for i in np.flatnonzero(sizes):
            used = np.flatnonzero(counts[i])
            table = canonical_codes(code_lengths(dict(zip(used.tolist(), counts[i, used].tolist()))))
            symbols, widths_of, codes_of = zip(*table)
            widths[i, symbols], codes[i, symbols] = widths_of, codes_of
        bodies = bit_strings(codes.ravel()[places], widths.ravel()[places].astype(np.int64), sizes)
        out += [w.tobytes() + n.to_bytes(8, "big") + bytes([pad]) + body for w, n, (body, pad) in zip(widths, sizes.tolist(), bodies)]
    return out


def huffman_encode(data: bytes) -> bytes:
    return huffman_encode_all([data])[0]


def huffman_decode(data: bytes) -> bytes:
    if len(data) < 265:
        raise ValueError("Huffman stream is too short")
    lengths = {s: n for s, n in enumerate(data[:256]) if n}
    size, pad = _size(data, 256, 8), data[264]
    if not lengths:
        return b""
    n_bits = 8 * (len(data) - 265)
    if pad > n_bits:
        raise ValueError("more padding than bits")
    out = _symbols(np.frombuffer(data, np.uint8, offset=265), n_bits - pad, canonical_codes(lengths))
    if len(out) != size:
        raise ValueError("size does not match")
    return out


def _symbols(body: np.ndarray, n: int, codes: list[tuple[int, int, int]]) -> bytes:
    """The symbols of the first ``n`` bits.  Codes of canonical order stand one behind the other, so a code is found by the greatest
    that is not above the bits; the length of one at every bit gives the way through them."""
    longest = codes[-1][1]
    if longest > 56:
        return _symbols_of_long_codes(body, n, codes)
    symbols, widths = np.array([s for s, _, _ in codes], np.uint8), np.array([w for _, w, _ in codes])
    firsts = np.array([c << longest - w for _, w, c in codes], np.uint64)
    behind = (codes[-1][2] + 1) << longest - codes[-1][1]
    word, short = words(body, ">"), min(longest, 12)
    table = np.repeat(widths[widths <= short], 1 << short - widths[widths <= short])
    table = np.append(table, np.zeros((1 << short) - len(table), np.int64))

    def bits_at(at: np.ndarray) -> np.ndarray:
        return (word[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(64 - longest)

    def steps(lo: int, hi: int) -> np.ndarray:
        bits = ((word[lo >> 3 : (hi + 7) >> 3, None] << np.arange(8, dtype=np.uint64)) >> np.uint64(64 - longest)).ravel()[lo & 7 :][: hi - lo]
        step = table[(bits >> np.uint64(longest - short)).astype(np.int64)]
        more = np.flatnonzero(step == 0)
        if len(more):
            step[more] = widths[np.searchsorted(firsts, bits[more], "right") - 1]
        return step

    at = path(n, steps)
    out = []
    for lo in range(0, len(at), 1 << 17):
        bits = bits_at(at[lo : lo + (1 << 17)])
        if (bits >= behind).any():
            raise ValueError("bits are no code")
        out.append(symbols[np.searchsorted(firsts, bits, "right") - 1])
    if len(at) and at[-1] + widths[symbols == out[-1][-1]][0] > n:
        raise ValueError("bits are no code")
    return np.concatenate(out).tobytes() if out else b""


def _symbols_of_long_codes(body: np.ndarray, n: int, codes: list[tuple[int, int, int]]) -> bytes:
    """The same one by one: codes longer than a word takes, which only a foreign encoder makes."""
    bits, symbols = np.unpackbits(body, count=n).tobytes().translate(b"01" + bytes(254)), {f"{c:0{w}b}".encode(): s for s, w, c in codes}
    out, at, widths = bytearray(), 0, sorted({w for _, w, _ in codes})
    while at < n:
        width = next((w for w in widths if bits[at : at + w] in symbols and at + w <= n), 0)
        if not width:
            raise ValueError("bits are no code")
        out.append(symbols[bits[at : at + width]])
        at += width
    return bytes(out)


# ---- greedy parsing shared by LZ77 and LZSS -----------------------------------------------------


def _tokens(values: Sequence[bytes], window: int, longest: int, chain: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of the values: their sizes, how many tokens each has, distances and values of the tokens, which are literals (0,
    byte) and references (distance, length) to the nearest of the longest matches; each three-byte key remembers its last
    ``chain`` places."""
    for lo, hi in slices(values):
        data, starts, ends = joined(values[lo:hi])
        at, distance, value = parsed(data, *nearest(data, starts, ends, window, longest, chain))
        bounds = np.searchsorted(at, np.append(starts, len(data)))
        yield (ends - starts).tolist(), np.diff(bounds), distance, value


def _parse(data: bytes, window: int, longest: int, chain: int) -> Iterator[tuple[int, int]]:
    for _, _, distance, value in _tokens([data], window, longest, chain):
        yield from zip(distance.tolist(), value.tolist())


# ---- LZ77: size (8), window (4), longest (2), padding (1), bits ---------------------------------


def _widths(window: int, longest: int) -> tuple[int, int]:
    return max(1, (window - 1).bit_length()), max(1, (longest - 3).bit_length())


def lz77_encode_all(values: Sequence[bytes], window: int = 32768, longest: int = 258) -> list[bytes]:
    wide, long = _widths(window, longest)
    out = []
    for sizes, counts, distance, value in _tokens(values, window, longest, 8):
        pair = distance > 0
        codes = np.where(pair, (1 << wide | distance.astype(np.int64) - 1) << long | value - 3, value)
        bodies = bit_strings(codes, np.where(pair, 1 + wide + long, 9), counts)
        out += [n.to_bytes(8, "big") + window.to_bytes(4, "big") + longest.to_bytes(2, "big") + bytes([pad]) + body for n, (body, pad) in zip(sizes, bodies)]
    return out


def lz77_encode(data: bytes, window: int = 32768, longest: int = 258) -> bytes:
    return lz77_encode_all([data], window, longest)[0]


def lz77_decode(data: bytes) -> bytes:
    if len(data) < 15:
        raise ValueError("LZ77 stream is too short")
    size, pad = _size(data, 0, 8), data[14]
    wide, long = _widths(int.from_bytes(data[8:12], "big"), int.from_bytes(data[12:14], "big"))
    n_bits = 8 * (len(data) - 15) - pad
    if n_bits < 0:
        raise ValueError("more padding than bits")
    body = np.frombuffer(data, np.uint8, offset=15)

    def steps(lo: int, hi: int) -> np.ndarray:
        return np.where(np.unpackbits(body[lo >> 3 : (hi + 7) >> 3])[lo & 7 :][: hi - lo], 1 + wide + long, 9)

    at = path(n_bits, steps)
    bits = words(body, ">")[at >> 3] << (at & 7).astype(np.uint64)
    pair = bits >> np.uint64(63) > 0
    at += np.where(pair, 1 + wide + long, 9)
    whole = len(at) - 1 if len(at) and at[-1] > n_bits else len(at)
    distance = np.where(pair, (bits << np.uint64(1) >> np.uint64(64 - wide)) + np.uint64(1), np.uint64(0)).astype(np.int64)
    length = (bits << np.uint64(1 + wide) >> np.uint64(64 - long)).astype(np.int64) + 3
    value = np.where(pair, length, (bits << np.uint64(1) >> np.uint64(56)).astype(np.int64))
    return expanded(distance[:whole], value[:whole], size)


# ---- LZSS: size (8), then a control byte for each eight tokens ------------------------------------


def lzss_encode_all(values: Sequence[bytes]) -> list[bytes]:
    out = []
    for sizes, counts, distance, value in _tokens(values, 4096, 18, 16):
        bodies = iter(grouped(distance, np.where(distance > 0, distance - 1 << 4 | value - 3, value), counts[counts > 0]))
        out += [n.to_bytes(8, "big") + (next(bodies) if n else b"") for n in sizes]
    return out


def lzss_encode(data: bytes) -> bytes:
    return lzss_encode_all([data])[0]


def lzss_decode(data: bytes) -> bytes:
    if len(data) < 8:
        raise ValueError("LZSS stream is too short")
    size, body = _size(data, 0, 8), np.frombuffer(data, np.uint8, offset=8)
    groups = path(len(body), lambda lo, hi: 9 + np.bitwise_count(body[lo:hi]).astype(np.int64))
    at, pair, value = ungrouped(body, groups)
    whole = int(np.searchsorted(at + pair, len(body)))
    pair, value = pair[:whole], value[:whole]
    return expanded(np.where(pair > 0, (value >> 4) + 1, 0), np.where(pair > 0, (value & 15) + 3, value), size)


# ---- RNC: magic (4), size (4), packed size (4), CRC-16 (2), blocks with their size (2) --------------

RNC_MAGIC, BLOCK = b"RNC\x01", 4096


def _oldest_match(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(distance, length) of the longest match of 2 to 17 bytes, the farthest of equals.

    The search only moves on: the oldest place of a match of some length comes before that of a
    longer one or is the same."""
    low, limit = max(0, at - BLOCK), min(17, end - at)
    if limit < 2:
        return 0, 0
    found, length = -1, 2
    p = data.find(data[at : at + 2], low, at + 1)
    while 0 <= p < at:
        while length < limit and data[p + length] == data[at + length]:
            length += 1
        found = p
        if length == limit:
            break
        p = data.find(data[at : at + length + 1], p + 1, at + length)
        length += 1
    else:
        length -= found >= 0
    return (at - found, length) if found >= 0 else (0, 0)


def rnc_encode_all(values: Sequence[bytes]) -> list[bytes]:
    out = []
    for lo, hi in slices(values):
        data, starts, ends = joined(values[lo:hi])
        at, distance, value = parsed(data, *oldest(data, starts, ends, BLOCK, 17))
        firsts = [np.arange(a, b, BLOCK) for a, b in zip(starts.tolist(), ends.tolist())]
        counts = np.diff(np.searchsorted(at, np.append(np.concatenate(firsts), len(data))))
        blocks = iter(grouped(distance, np.where(distance > 0, distance - 1 << 4 | value - 2, value), counts))
        for own, whole, crc in zip(firsts, values[lo:hi], crc16_of_all(values[lo:hi]).tolist()):
            body = b"".join(len(b).to_bytes(2, "big") + b for b in (next(blocks) for _ in own))
            out.append(RNC_MAGIC + len(whole).to_bytes(4, "big") + len(body).to_bytes(4, "big") + crc.to_bytes(2, "big") + body)
    return out


def rnc_encode(data: bytes) -> bytes:
    return rnc_encode_all([data])[0]


def rnc_decode(data: bytes) -> bytes:
    if len(data) < 14 or data[:4] != RNC_MAGIC:
        raise ValueError("no RNC stream")
    size, at, done, parts = _size(data, 4, 4), 14, 0, []
    while done < size:
        n = int.from_bytes(data[at : at + 2], "big")
        block, at, i, groups = data[at + 2 : at + 2 + n], at + 2 + n, 0, []
        if len(block) < n or not n:
            raise ValueError("RNC block is cut off")
        while i < n:
            groups.append(i)
            i += 9 + block[i].bit_count()
        places, pair, value = ungrouped(np.frombuffer(block, np.uint8), np.array(groups))
        used = int(np.searchsorted(places, n))
        if used and places[used - 1] + pair[used - 1] >= n:
            raise ValueError("RNC block is cut off")
        pair, value = pair[:used], value[:used]
        parts.append((np.where(pair > 0, (value >> 4) + 1, 0), np.where(pair > 0, (value & 15) + 2, value)))
        done += int(np.where(pair > 0, parts[-1][1], 1).sum())
    if done != size:
        raise ValueError("size does not match")
    out = expanded(*map(np.concatenate, zip(*parts)), size) if parts else b""
    if crc16_of_all([out])[0] != int.from_bytes(data[12:14], "big"):
        raise ValueError("CRC-16 does not match")
    return out


# ---- methods --------------------------------------------------------------------------------------

Codec = Callable[[bytes], bytes]
#: Encoder of many values and decoder of one.
Pair = tuple[Callable[[Sequence[bytes]], list[bytes]], Codec]


def _pair(method: str, window: int = 32768) -> Pair:
    pairs: dict[str, Pair] = {
        "huffman": (huffman_encode_all, huffman_decode),
        "lz77": (lambda v: huffman_encode_all(lz77_encode_all(v, window)), lambda b: lz77_decode(huffman_decode(b))),
        "lzss_rnc": (lambda v: rnc_encode_all(lzss_encode_all(v)), lambda b: lzss_decode(rnc_decode(b))),
        "lz77_only": (lambda v: lz77_encode_all(v, window), lz77_decode),
        "lzss_only": (lzss_encode_all, lzss_decode),
        "rnc_only": (rnc_encode_all, rnc_decode),
    }
    if method not in pairs:
        raise ValueError(f"unknown method {method}")
    return pairs[method]


def method_codecs(method: str, window: int = 32768) -> tuple[Codec, Codec]:
    """Encoder and decoder of a method or of a single codec; an unknown name raises."""
    encode_all, decode = _pair(method, window)
    return lambda b: encode_all([b])[0], decode


def in_slices(run: Callable[..., list[bytes | None]], content: pa.Array, *others: pa.Array) -> pa.Array:
    """``run`` over lists of the values, about a million bytes at a time, so that Python holds little of a batch."""
    sizes = pc.fill_null(pc.binary_length(content), 0).to_pylist()
    cuts = ([a[lo:hi].to_pylist() for a in (content, *others)] for lo, hi in ranges(sizes, 1 << 20, 4096))
    return pa.concat_arrays([pa.array([], pa.binary()), *(pa.array(run(*lists), pa.binary()) for lists in cuts)])


def encoder(method: str, window: int = 32768):
    encode_all = _pair(method, window)[0]

    def run(values):
        known = iter(encode_all([v for v in values if v is not None]))
        return [None if v is None else next(known) for v in values]

    @arrow_udf(BinaryType())
    def encoded(content: pa.Array) -> pa.Array:
        return in_slices(run, content)

    return encoded


def decoder(method: str, window: int = 32768, on_error: str = "fail"):
    """``on_error`` null gives null for chunks that do not decode."""
    decode = _pair(method, window)[1]

    def one(b):
        try:
            return None if b is None else decode(b)
        except ValueError:
            if on_error == "fail":
                raise
            return None

    @arrow_udf(BinaryType())
    def decoded(content: pa.Array) -> pa.Array:
        return in_slices(lambda values: list(map(one, values)), content)

    return decoded
