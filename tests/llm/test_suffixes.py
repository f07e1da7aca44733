import random

import numpy as np
import pyarrow as pa

from factorlake.llm import bytesblock, suffix_dedup, suffixes


def strings():
    rnd = random.Random(9)
    out = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 60))) for _ in range(12)]
    return out + [b"", b"a", b"a" * 50, out[0] + out[1], out[0] + out[1], b"abcabcabc" * 8]


def test_suffix_array_and_permuted_common_prefixes():
    text, *_ = suffixes.join(strings())
    array = suffixes.suffix_array(text)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert array.tolist() == want
    before = np.full(len(text), -1)
    before[array[1:]] = array[:-1]
    for cap in (1, 7, 1000):
        got = suffixes.permuted_common_prefixes(text, before, np.arange(len(text)), cap)
        for i, b in enumerate(before.tolist()):
            n = 0
            while b >= 0 and n < cap and max(i, b) + n < len(text) and text[i + n] == text[b + n]:
                n += 1
            assert got[i] == n


def test_types_and_leftmost_smaller():
    text, *_ = suffixes.join(strings())
    smaller = suffixes.smaller_types(text)
    tail = [text[i:].tolist() for i in range(len(text))]
    assert smaller.tolist() == [i == len(text) - 1 or tail[i] < tail[i + 1] for i in range(len(text))]
    assert suffixes.leftmost_smaller(smaller).tolist() == [i for i in range(1, len(text)) if smaller[i] and not smaller[i - 1]]


def test_same_bytes():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 400)
    text[200:300] = text[50:150]
    a = np.sort(np.concatenate((np.arange(195, 290), rng.integers(0, 380, 40))))
    b = np.where((a >= 195) & (a < 290), a - 150, np.maximum(a - rng.integers(1, 9, len(a)), 0))
    for n in (1, 5, 12):
        assert suffixes.same_bytes(text, a, b, n).tolist() == [(text[i : i + n] == text[j : j + n]).all() for i, j in zip(a, b)]


def test_repeated_starts_against_brute_force():
    for length in (1, 4, 9):
        s = strings()
        every = [x[i : i + length] for x in s for i in range(len(x) - length + 1)]
        got = suffixes.repeated_starts(s, length)
        assert [x.tolist() for x in got] == [[i for i in range(len(x) - length + 1) if every.count(x[i : i + length]) > 1] for x in s]


def test_a_worker_keeps_no_memory_of_long_strings():
    before = bytesblock.powers(10)
    up, down = bytesblock.powers(4 * bytesblock.BLOCK_BYTES)
    assert len(up) == len(down) == 4 * bytesblock.BLOCK_BYTES and np.array_equal(up[:10], before[0][:10]) and (up * down == 1).all()
    assert len(bytesblock.powers(10)[0]) < 2 * bytesblock.BLOCK_BYTES


def test_shards_stay_small():
    rnd = np.random.default_rng(3)
    seg = [rnd.integers(0, 256, 100_000, dtype=np.uint8).tobytes() for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(range(12), pa.int64()), pa.array(seg, pa.binary())], names=["kg", "whole", "seg"])
    out = list(suffix_dedup._suffix_sort(200)(iter([batch])))
    assert sum(b.num_rows for b in out) == 12 and max(b.num_rows for b in out) <= 7
