"""Induced-sorting suffix arrays in numpy, and the repeats they show.

The bucket scans of induced sorting are vectorised: all entries of one bucket
that are ready induce their predecessors in one step, and a bucket is visited
again only while it induces into itself (as often as its longest run).
"""

from __future__ import annotations

import numpy as np

from factorlake.llm.bytesblock import Rolling, spread

END, BREAK, FIRST = 0, 1, 2  # the closing symbol, the one between strings, the first byte's


def join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all strings with a break after each and one end; where each starts; its size."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16) + np.uint16(FIRST)
    text[starts + sizes] = BREAK
    return np.append(text, np.uint16(END)), starts, sizes


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last is."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[at] > 0, True)


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of S type whose left neighbour is of L type."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array that leftmost-smaller suffixes in the order of `seeds` induce."""
    sigma = len(bounds) - 1
    array = np.full(len(text), -1, np.int64)
    chars = text[seeds]
    order = np.argsort(chars, kind="stable")
    sorted_seeds, per = seeds[order], np.bincount(chars, minlength=sigma)
    seed_ends = np.cumsum(per)
    head, tail = bounds[:-1].copy(), bounds[1:].copy()

    def put(found: np.ndarray, cursor: np.ndarray, sign: int) -> None:
        c = text[found]
        o = np.argsort(c, kind="stable")
        kinds, first, count = np.unique(c[o], return_index=True, return_counts=True)
        rank = np.arange(len(found)) - np.repeat(first, count)
        base = np.repeat(cursor[kinds], count)
        array[base + rank if sign > 0 else base - 1 - rank] = found[o]
        cursor[kinds] += sign * count

    for c in np.flatnonzero(np.diff(bounds)):
        done = bounds[c]
        while done < head[c]:
            ready = array[done : head[c]]
            done = head[c]
            before = ready[ready > 0] - 1
            before = before[text[before] >= c]
            if len(before):
                put(before, head, 1)
        before = sorted_seeds[seed_ends[c] - per[c] : seed_ends[c]] - 1
        if len(before):
            put(before, head, 1)
    array[0] = len(text) - 1  # the end's suffix
    tail[END] = 0
    for c in np.flatnonzero(np.diff(bounds))[::-1]:
        done = bounds[c + 1] if c != END else 0
        while done > tail[c]:
            ready = array[tail[c] : done][::-1]
            done = tail[c]
            before = ready[ready > 0] - 1
            before = before[text[before] <= c]
            if len(before):
                put(before, tail, -1)
        ready = array[bounds[c] : head[c]][::-1] if c != END else array[:1]
        before = ready[ready > 0] - 1
        before = before[(text[before] < c) if c != END else np.zeros(len(before), bool)]
        if len(before):
            put(before, tail, -1)
    return array


def _order_names(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of the reduced string, by doubling the compared length up to depth names.

    A bucket scan over an alphabet as large as the string has nothing to
    vectorise, so the recursion of induced sorting continues as doubling.
    """
    n, span = len(names), 1
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while span < n and (depth is None or span < depth):
        top = int(rank.max()) + 2
        key = rank * top
        key[:-span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank[order] = new
        if new[-1] == n - 1:
            break
        span *= 2
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of symbols that close with one END, the least.

    With a depth, suffixes that agree on their first depth symbols may stand
    in any order among themselves.
    """
    smaller = smaller_types(text)
    marks = leftmost_smaller(smaller)
    bounds = np.append(0, np.cumsum(np.bincount(text)))
    if len(marks) > 1:
        first = _induce(text, smaller, marks, bounds)
        is_mark = np.zeros(len(text), bool)
        is_mark[marks] = True
        by_piece = first[is_mark[first]]
        follow = np.searchsorted(marks, by_piece)
        ends = np.append(marks[1:], len(text) - 1)[follow] + 1
        roll = Rolling(text, _CODES)
        value, size = roll(by_piece, ends), ends - by_piece
        names = np.zeros(len(marks), np.int64)
        names[follow] = np.append(0, np.cumsum((value[1:] != value[:-1]) | (size[1:] != size[:-1])))
        if names.max() < len(marks) - 1:
            marks = marks[_order_names(names, None if depth is None else depth // 2 + 1)]
        else:
            marks = by_piece
    return _induce(text, smaller, marks, bounds)


_CODES = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def permuted_common_prefixes(text: np.ndarray, before: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """For each position in `at`, in text order, how many symbols it shares with the suffix before it in the array, up to cap.

    before holds that suffix for every position (-1: none). Where it is 0 the
    prefix is 0; near the end of the text cap is cut to what is left there. Equality is
    by rolling hash; halving steps find the length.
    """
    other = before[at]
    roll = Rolling(text, _CODES)
    most = np.minimum(cap, len(text) - np.maximum(at, other))
    most[other < 0] = 0
    shared = np.zeros(len(at), np.int64)
    # The most that may be shared first; then, for prefixes that are shorter, the powers of two from the top.
    whole = np.flatnonzero(most > 0)
    a, b, n = at[whole], other[whole], most[whole]
    done = roll(a, a + n) == roll(b, b + n)
    shared[whole[done]] = n[done]
    rest = whole[~done]
    step = 1 << (int(cap).bit_length() - 1)
    while step and len(rest):
        fit = rest[shared[rest] + step <= most[rest]]
        a, b, k = at[fit], other[fit], shared[fit]
        same = roll(a + k, a + k + step) == roll(b + k, b + k + step)
        shared[fit[same]] += step
        step >>= 1
    return shared


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether text[a : a + length] and text[b : b + length] agree, symbol by symbol; a ascends.

    Neighbouring pairs at one distance overlap in all but a symbol, so each run of
    them is compared once over its whole stretch.
    """
    if not len(a):
        return np.zeros(0, bool)
    new = np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a))) + length - 1
    x = spread(a[first], size)
    y = spread(b[first], size)
    wrong = np.append(0, np.cumsum(text[x] != text[y]))
    at = np.arange(len(a)) + (np.cumsum(new) - 1) * (length - 1)
    return wrong[at + length] == wrong[at]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, the starts of its `length`-byte substrings that start anywhere else too.

    A start repeats when it shares `length` symbols with the suffix before or
    after it in the array: permuted common prefixes, whose finds are compared byte by byte.
    """
    text, starts, sizes = join(strings)
    array = suffix_array(text, length)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[owner] + offset
    full = np.zeros(len(text), bool)
    full[at] = True
    before = np.full(len(text), -1, np.int64)
    before[array[1:]] = array[:-1]
    able = at[(before[at] >= 0) & full[np.maximum(before[at], 0)]]
    a = able[permuted_common_prefixes(text, before, able, length) >= length]
    b = before[a]
    same = same_bytes(text, a, b, length)
    again = np.zeros(len(text), bool)
    again[a[same]] = True
    again[b[same]] = True
    hit = again[at]
    return np.split(offset[hit], np.cumsum(np.bincount(owner[hit], minlength=len(strings)))[:-1])
