"""Exponential smoothing as an associative scan, so that neither a bar nor a symbol needs a step of its own.

y = alpha x + (1 - alpha) y is a map y -> a y + b, and maps compose. A block of
bars composes them pairwise at distances 1, 2, 4 ..., all bars at once; a
block hands (count, y) to the next one. Ranges of one symbol are put together in
the same way from (count, first x, y had it started here), as a series that
starts at its first value is one that comes from just that value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Smoothing:
    """y over non-missing x from the first one on; missing until `least` values came."""

    alpha: float
    least: int


def span(n: int, least: int | None = None) -> Smoothing:
    return Smoothing(2.0 / (n + 1), max(2, n // 2) if least is None else least)


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of each step of y = a y + b from y = 0 on."""
    a, b = a.copy(), b.copy()
    k = 1
    while k < len(b) and a.any():
        b[k:] = b[k:] + a[k:] * b[:-k]
        a[k:] = a[k:] * a[:-k]
        a[:k] = 0.0
        k *= 2
    return b


def smooth(x: np.ndarray, starts: np.ndarray, how: Smoothing, count: int = 0, y: float = np.nan) -> tuple[np.ndarray, int, float]:
    """(smoothed, count and y at its end) of a block of x whose series begin where `starts` says; x has one value at least.

    Where the first value starts no series, it goes on from (count, y). Missing x
    keep y. `smoothed` is missing under `least` values.
    """
    series = np.cumsum(starts)  # 0 is the one that goes on
    at = np.flatnonzero(~np.isnan(x))
    own, known = series[at], x[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = own[1:] != own[:-1]
    a, b = np.where(fresh, 0.0, 1.0 - how.alpha), np.where(fresh, known, how.alpha * known)
    place = np.arange(len(at))
    counts = place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1
    if not starts[0] and count:
        counts = counts + np.where(own == 0, count, 0)
        if len(at) and own[0] == 0:
            b[0] = how.alpha * known[0] + (1.0 - how.alpha) * y
    # Beside the known values, one before all of them: the state that goes on.
    ys, counts, own = np.append(y, composed(a, b)), np.append(0 if starts[0] else count, counts), np.append(0, own)
    last = np.searchsorted(at, np.arange(len(x)), side="right")
    n = np.where(own[last] == series, counts[last], 0)
    return np.where(n >= how.least, ys[last], np.nan), int(n[-1]), float(ys[last[-1]]) if n[-1] else np.nan


def joined(state: tuple[int, float], piece: tuple[int, float, float], how: Smoothing) -> tuple[int, float]:
    """(count, y) after a piece (count, first x, y had it started there) that follows a state."""
    (n, y), (m, first, end) = state, piece
    if not m:
        return n, y
    return (m, end) if not n else (n + m, end + (1.0 - how.alpha) ** m * (y - first))
