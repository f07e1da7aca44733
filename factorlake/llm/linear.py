"""Fitting linear models where the rows stay in Spark: sums over packed rows, and steps on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def total(packed: DataFrame, of: Callable[..., np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of packed (binary columns only) of the `width` numbers that of(*buffers) gives, one job; a task returns one vector."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            for values in zip(*batch.columns):
                out += of(*(v.as_buffer() for v in values))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

    parts = [np.frombuffer(bytes(r["s"]), np.float64) for r in packed.mapInArrow(kernel, "s binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(width)


def lbfgs(risk: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 8, gain: float = 1e-6) -> np.ndarray:
    """Least risk from x on by limited-memory quasi-Newton steps; risk gives value and gradient."""
    value, slope = risk(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, seen = slope.copy(), []
        for s, t in reversed(moves):
            seen.append((s @ way) / (t @ s))
            way -= seen[-1] * t
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.abs(slope).sum(), 1e-12)
        for (s, t), a in zip(moves, reversed(seen)):
            way += s * (a - (t @ way) / (t @ s))
        for halving in range(20):
            move = -way / 2**halving
            next_value, next_slope = risk(x + move)
            if next_value <= value + 1e-4 * (slope @ move):
                break
        else:
            break
        x, turn, won = x + move, next_slope - slope, value - next_value
        if move @ turn > 1e-12:
            moves = [*moves, (move, turn)][-memory:]
        value, slope = next_value, next_slope
        if won < gain * max(1.0, abs(value)):
            break
    return x
