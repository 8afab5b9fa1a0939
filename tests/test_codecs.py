"""Hand-made vectors, round trips, corruption and tie-breaks of the codecs and checksums."""

import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelode.functions import checksums
from bytelode.functions import codecs as c
from bytelode.functions import tokens

H = bytes.fromhex
METHODS = ("huffman", "lz77", "lzss_rnc", "lz77_only", "lzss_only", "rnc_only")


def random_bytes(n, seed=42):
    return (np.random.RandomState(seed).randint(0, 2**32, n, dtype=np.uint32) & 0xFF).astype(np.uint8).tobytes()


SENTENCE = b"the quick brown fox jumps over the lazy dog. "
INPUTS = [b"", b"\x42", b"A" * 1000, bytes(range(256)), b" ".join([b"hello world"] * 3), random_bytes(4096), random_bytes(10000, 55), b"abcdefghij" * 600, SENTENCE * 100]


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("data", INPUTS, ids=range(len(INPUTS)))
def test_round_trip(method, data):
    encode, decode = c.method_codecs(method)
    assert decode(encode(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(METHODS))
def test_round_trip_any(data, method):
    encode, decode = c.method_codecs(method)
    assert decode(encode(data)) == data


@pytest.mark.parametrize("window", [256, 4096, 65536])
def test_windows(window):
    data = SENTENCE * 30 + random_bytes(4096, 13)
    encode, decode = c.method_codecs("lz77", window)
    assert decode(encode(data)) == data


def test_vectors():
    one = c.huffman_encode(b"\x42")
    assert one[0x42] == 1 and sum(one[:256]) == 1 and one[256:] == H("0000000000000001" "07" "00")
    assert c.huffman_encode(b"") == bytes(265)
    assert c.lz77_encode(b"\x55") == H("0000000000000001" "00008000" "0102" "07" "2A80")
    assert c.lz77_encode(b"abcabc") == H("0000000000000006" "00008000" "0102" "05" "30988C70004000")
    assert c.lzss_encode(b"\xab") == H("0000000000000001" "00" "AB")
    assert c.rnc_encode(b"\x42") == H("524E4301" "00000001" "00000004" "018C" "0002" "0042")
    assert c.rnc_encode(b"aaaa") == H("524E4301" "00000004" "00000006" "D4C6" "0004" "40610001")


def test_sizes():
    assert len(c.huffman_encode(b"X" * 10000)) == 1515
    assert len(c.lz77_encode(b"A" * 5000)) == 77
    assert len(c.lz77_encode(b"A" * 200 + b"B" * 200)) == 24
    assert len(c.lzss_encode(b"Q" * 5000)) == 600
    assert len(c.lz77_encode(SENTENCE * 100)) < 0.5 * 4500


def test_ties():
    text = b"abcXabcYabc"
    assert [t for t in c._parse(text, 4096, 18, 16) if t[0]][-1] == (4, 3)
    assert c._oldest_match(b"abXabYab", 6, 8) == (6, 2)


def test_oldest_match_is_the_brute_force_one():
    rng = random.Random(3)
    for letters in (2, 3, 26):
        data = bytes(rng.randrange(letters) for _ in range(1500))
        for at in rng.sample(range(1500), 100):
            best = (0, 0)
            for p in range(max(0, at - 4096), at):
                k = 0
                while k < 17 and at + k < 1500 and data[p + k] == data[at + k]:
                    k += 1
                if k >= 2 and k > best[1]:
                    best = (at - p, k)
            assert c._oldest_match(data, at, 1500) == best


CORRUPT = [
    (c.huffman_decode, bytes(10)),
    (c.huffman_decode, b"\xff" * 300),
    (c.lz77_decode, bytes(5)),
    (c.lz77_decode, c.lz77_encode(b"hello world")[:15]),
    (c.lzss_decode, bytes(4)),
    (c.lzss_decode, H("0000000000000064" "80" "AA")),
    (c.rnc_decode, bytes(5)),
    (c.rnc_decode, b"XXXX" + c.rnc_encode(b"hello")[4:]),
    (c.rnc_decode, c.rnc_encode(b"hello hello")[:-1] + b"\x00"),
]


@pytest.mark.parametrize("decode,data", CORRUPT, ids=range(len(CORRUPT)))
def test_corrupt(decode, data):
    with pytest.raises(ValueError):
        decode(data)


def test_unknown_method():
    with pytest.raises(ValueError):
        c.method_codecs("zip")


def test_crc16_of_all():
    values = [b"", b"123456789", random_bytes(1), random_bytes(70_000, 3), b"", random_bytes(5000, 5)]
    assert checksums.crc16_of_all(values).tolist() == [checksums.crc16_of(v) for v in values]
    assert checksums.crc16_of_all([]).tolist() == []


def test_checksums():
    assert checksums.crc16_of(b"123456789") == 0xFEE8
    for a, b in ((b"", b"x"), (b"abc", b"hello"), (random_bytes(512), random_bytes(700, 7))):
        assert checksums.shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def peak(run) -> int:
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_crc16_holds_no_words_for_a_batch():
    values = [random_bytes(1 << 17, k) for k in range(16)]
    few, many = (peak(lambda: checksums.crc16_of_all(values[:n])) for n in (4, 16))
    assert many - few < 4 * (12 << 17)  # less than four bytes for each more
    assert checksums.crc16_of_all(values[:3], 1000).tolist() == checksums.crc16_of_all(values[:3]).tolist()


def small_inputs():
    rng = random.Random(5)
    return [b"", b"a", *INPUTS[1:7], *(bytes(rng.randrange(k) for _ in range(rng.choice((1, 2, 3, 9, 200, 900)))) for k in (1, 2, 3, 26) for _ in range(8))]


def plain_parse(data, window, longest, chain):
    out, at = [], 0
    while at < len(data):
        places = [p for p in range(max(0, at - window), at) if data[p : p + 3] == data[at : at + 3] and at + 3 <= len(data)][-chain:]
        best = (0, data[at])
        for p in reversed(places):
            k = 3
            while k < longest and at + k < len(data) and data[p + k] == data[at + k]:
                k += 1
            if k > (best[1] if best[0] else 2):
                best = (at - p, k)
        out.append(best)
        at += best[1] if best[0] else 1
    return out


@pytest.mark.parametrize("part", [300, 1 << 17])
def test_tokens_are_those_of_a_plain_search(monkeypatch, part):
    monkeypatch.setattr(tokens, "PART", part)
    values = [v[:1500] for v in small_inputs()]
    for window, longest, chain in ((4096, 18, 16), (100, 258, 8)):
        for value in values:
            assert list(c._parse(value, window, longest, chain)) == plain_parse(value, window, longest, chain)
    for value in values:
        data, starts, ends = tokens.joined([b"before", value, b"", b"behind"])
        distance, length = tokens.oldest(data, starts, ends, c.BLOCK, 17)
        got = list(zip(distance.tolist(), length.tolist()))[6 : 6 + len(value)]
        assert got == [c._oldest_match(value, at, len(value)) for at in range(len(value))]


@pytest.mark.parametrize("method", METHODS)
def test_many_values_are_encoded_as_each_alone(monkeypatch, method):
    values = small_inputs()
    encode_all, decode = c._pair(method)
    alone = [encode_all([v])[0] for v in values]
    monkeypatch.setattr(tokens, "PART", 1000)
    assert encode_all(values) == alone and [decode(x) for x in alone] == values


def test_long_huffman_codes():
    lengths = bytearray(256)
    lengths[:60] = range(1, 61)
    bits = "110" + "0" + "1" * 59 + "0"  # symbols 2, 0 and 59
    pad = -len(bits) % 8
    body = int(bits + "0" * pad, 2).to_bytes((len(bits) + pad) // 8, "big")
    assert c.huffman_decode(bytes(lengths) + (3).to_bytes(8, "big") + bytes([pad]) + body) == bytes([2, 0, 59])
    with pytest.raises(ValueError):
        c.huffman_decode(bytes(lengths) + (3).to_bytes(8, "big") + bytes([0]) + b"\xff" * 9)


@pytest.mark.parametrize("method,most", [("huffman", 4), ("lz77", 15), ("lzss_rnc", 15), ("lz77_only", 9), ("lzss_only", 9), ("rnc_only", 9)])
def test_codecs_take_little_time_and_memory(method, most):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    values = [" ".join(rng.choice(words) for _ in range(500)).encode() for _ in range(64)]
    encode, decode = c.encoder(method).func, c.decoder(method).func

    def run(times):
        batch = pa.array(values * times, pa.binary())
        assert decode(encode(batch)).equals(batch)

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    run(1)
    plain = min(seconds(lambda: [checksums.crc16_of(v) for v in values]) for _ in range(3))
    assert min(seconds(lambda: run(1)) for _ in range(3)) < most * plain  # a loop over the bytes in Python, that many times
    assert peak(lambda: run(4)) < 48 << 20
