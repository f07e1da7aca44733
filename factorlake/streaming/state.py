"""Bounded buffers in streaming state: entries of their own, with a time to live."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORED, SERVED = 500, 120


class Newest(StatefulProcessor):
    """Keeps the n newest (order, item) of a key in map state: a batch writes what it brings and removes what that pushes out.

    With a time to live an entry leaves so many milliseconds after it was written, so keys that
    fall silent leave no state behind.
    """

    def __init__(self, n: int, order: str, live_ms: int | None):
        self.n, self.order, self.live_ms = n, order, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("newest", "at long, item string", "copies int", self.live_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(k): v[0] for k, v in self.kept.iterator()}
        met = Counter(held)
        for f in rows:
            met.update(zip((int(x) for x in f[self.order]), f["item"]))
        left, items = self.n, []
        for entry in sorted(met, reverse=True):
            copies = min(met[entry], left)
            left -= copies
            items += [entry[1]] * copies
            if copies and copies != held.get(entry):
                self.kept.updateValue(entry, (copies,))
            elif not copies and entry in held:
                self.kept.removeKey(entry)
        yield pd.DataFrame({"inst_id": pd.Series([key[0]], dtype=object), "items": pd.Series([items], dtype=object)})

    def close(self) -> None:
        pass


def last_n(rows: DataFrame, n: int = SERVED, order: str = "seq", live_ms: int | None = None) -> DataFrame:
    """(inst_id, items): the n newest of rows (inst_id, order, item) per instrument, newest first, after each batch that has rows of it.

    State holds n entries per instrument, however long the stream runs. live_ms is for
    streams that run on: one that ends with what is available now would make
    empty batches without end, waiting for times to come.
    """
    given = rows.select("inst_id", F.col(order).cast("long").alias(order), F.col("item").cast("string").alias("item"))
    return given.groupBy("inst_id").transformWithStateInPandas(Newest(n, order, live_ms), "inst_id string, items array<string>", "Update", "ProcessingTime" if live_ms else "None")
