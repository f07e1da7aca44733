"""A running feed: its state, its message count and snapshots written at most once per interval."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Milliseconds between two snapshots.
THROTTLE = 250


class LiveFeed:
    """A streaming query that hands its newest table to `write`, once per interval at most.

    Spark's trigger does the throttling, its checkpoint the reconnect: a feed
    started again over the same folder goes on after the last message it wrote.
    """

    def __init__(self, stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every_ms: int = THROTTLE, mode: str = "append"):
        self.query: StreamingQuery | None = None
        self.counted: dict[int, int] = {}
        self._writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(processingTime=f"{every_ms} milliseconds")

    def start(self) -> LiveFeed:
        self.query = self._writer.start()
        return self

    def state(self) -> str:
        """idle before the start, then starting until a batch is done, running, and stopped or error at the end."""
        if self.query is None:
            return "idle"
        if self.query.exception() is not None:
            return "error"
        if not self.query.isActive:
            return "stopped"
        return "running" if self.query.lastProgress else "starting"

    def messages(self) -> int:
        """Messages read so far; each batch counts once."""
        for p in self.query.recentProgress if self.query else ():
            self.counted[p["batchId"]] = max(self.counted.get(p["batchId"], 0), p["numInputRows"])
        return sum(self.counted.values())

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def status(self) -> dict[str, object]:
        error = self.query.exception() if self.query else None
        return {"state": self.state(), "messages": self.messages(), "error": str(error) if error else None}


#: Seconds before the first and at most before a later restart; each failure in a row doubles them.
FIRST_WAIT, LONGEST_WAIT = 1.0, 15.0


class Supervisor(StreamingQueryListener):
    """Keeps a query running: one that fails is started again after a pause, from its checkpoint.

    `start` starts the query over the same checkpoint folder each time, so nothing
    is lost or written twice that the sink itself does not repeat. A batch that is
    done ends a row of failures. A query that was stopped stays stopped.
    """

    def __init__(self, spark: SparkSession, start: Callable[[], StreamingQuery], first: float = FIRST_WAIT, longest: float = LONGEST_WAIT):
        self.spark, self._start, self.first, self.longest = spark, start, first, longest
        self.query: StreamingQuery | None = None
        self.failures: list[str] = []
        self.waits: list[float] = []
        self._in_row = 0
        self._ended = threading.Event()
        self._failed = threading.Event()
        self._watch: threading.Thread | None = None

    def start(self) -> Supervisor:
        self.spark.streams.addListener(self)
        self._watch = threading.Thread(target=self._keep, daemon=True)
        self._watch.start()
        return self

    def _keep(self) -> None:
        while not self._ended.is_set():
            self._failed.clear()
            try:
                self.query = self._start()
            except Exception as e:  # a start that fails counts like a run that does
                self._note(f"{type(e).__name__}: {e}")
            self._failed.wait()
            if self._ended.is_set():
                return
            self.waits.append(min(self.longest, self.first * 2 ** (self._in_row - 1)))
            self._ended.wait(self.waits[-1])

    def _note(self, error: str) -> None:
        self.failures.append(error)
        self._in_row += 1
        self._failed.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.query is not None and event.progress.runId == self.query.runId and event.progress.numInputRows:
            self._in_row = 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.query is not None and str(event.runId) == str(self.query.runId) and event.exception:
            self._note(event.exception)

    def state(self) -> str:
        """idle, running, waiting (for a restart) or stopped."""
        if self._watch is None:
            return "idle"
        if self._ended.is_set():
            return "stopped"
        return "waiting" if self._failed.is_set() or self.query is None else "running"

    def stop(self) -> None:
        self._ended.set()
        self._failed.set()
        if self._watch is not None:
            self._watch.join()
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.spark.streams.removeListener(self)
