"""Numpy helpers over the UTF-8 bytes of an Arrow string column.

Texts of an Arrow batch already lie end to end in one buffer; the helpers work
on that buffer in blocks of about a quarter of a megabyte, so memory does not follow the
batch size. A single text longer than the block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_MASK = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: empty) and len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if binary else "", column.type))
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def blocks(body: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, body[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    # Workers serve many tasks; what Arrow keeps for later batches would add up beside the executor's heap.
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; those of a block are kept, more would stay with a worker that serves other stages."""
    global _powers
    if _powers is not None and len(_powers[0]) >= n:
        return _powers
    size, made = max(n, BLOCK_BYTES + 1024), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size == BLOCK_BYTES + 1024:
        _powers = (made[0], made[1])
    return made[0], made[1]


class Rolling:
    """Polynomial hashes modulo 2**64 of any byte ranges of a block, in constant time each."""

    def __init__(self, body: np.ndarray, codes: np.ndarray = BYTE_CODES):
        up, down = powers(len(body) + 1)
        self.up = up
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(codes[body] * down[: len(body)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges: starts[i], starts[i]+1, ... sizes[i] of each."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def sliding(f: np.ufunc, a: np.ndarray, width: int, fill) -> np.ndarray:
    """f over a[i : i + width] for every i, past the end filled, in linear time."""
    n = len(a)
    rows = -(-n // width) + 1
    padded = np.full(rows * width, fill, a.dtype)
    padded[:n] = a
    grid = padded.reshape(rows, width)
    ahead = f.accumulate(grid, axis=1).ravel()
    behind = f.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[width - 1 : width - 1 + n])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def char_grams(body: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...], bits: int, ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of 2**bits) of all n-grams of characters of a block's texts, A-Z lower-cased, and how many each text has.

    Characters are code points: an n-gram is the bytes from one character's first
    to before the n-th after it. With ends, each text stands between two blanks.
    """
    sizes = np.diff(offs)
    if ends:
        wide = sizes + 2
        start = np.cumsum(wide) - wide
        text = np.full(int(wide.sum()), 32, np.uint8)
        text[spread(start + 1, sizes)] = _LOWER[body]
    else:
        start, text = offs[:-1], _LOWER[body]
    chars = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
    first = np.searchsorted(chars, np.append(start, len(text)))
    each = [np.maximum(np.diff(first) - n + 1, 0) for n in lengths]
    count = sum(each)
    out, place = np.zeros(int(count.sum()), np.int64), np.cumsum(count) - count
    roll = Rolling(text)
    for n, own in zip(lengths, each):
        at = spread(first[:-1], own)
        out[spread(place, own)] = (roll(chars[at], chars[at + n]) >> np.uint64(64 - bits)).astype(np.int64)
        place = place + own
    return out, count


def sql_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed long, as Spark has it."""
    return x.view(np.int64)
