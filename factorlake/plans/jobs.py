"""Runs in the background: each under a job tag of its own, its states in the run table, ended by a cancel."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

from factorlake.operators.store import RunLog
from factorlake.plans.pipeline import Canceled, RunContext


class Jobs:
    """Starts work(context) in threads; states queued, running, succeeded, failed and canceled go to the log."""

    def __init__(self, spark: SparkSession, log: RunLog, at_once: int = 2):
        self.spark, self.log = spark, log
        self._slots = threading.Semaphore(at_once)
        self._write = threading.Lock()
        self._stops: dict[str, threading.Event] = {}
        self._threads: dict[str, threading.Thread] = {}

    def _mark(self, run_id: str, status: str, error: str | None = None) -> None:
        with self._write:
            self.log.mark(run_id, status, error)

    def submit(self, run_id: str, work: Callable[[RunContext], object]) -> None:
        if run_id in self._threads:
            raise ValueError(f"the run {run_id!r} is there already")
        self._stops[run_id] = threading.Event()
        self._mark(run_id, "queued")
        self._threads[run_id] = threading.Thread(target=self._run, args=(run_id, work), daemon=True)
        self._threads[run_id].start()

    def _run(self, run_id: str, work: Callable[[RunContext], object]) -> None:
        stop = self._stops[run_id]
        with self._slots:
            if stop.is_set():
                return self._mark(run_id, "canceled")
            self._mark(run_id, "running")
            self.spark.sparkContext.addJobTag(run_id)
            status, error = "succeeded", None
            try:
                work(RunContext(run_id, is_canceled=stop.is_set))
            except Canceled:
                status = "canceled"
            except Exception as e:  # a run that fails leaves the others; a cancel ends Spark's jobs by an error of theirs
                status, error = ("canceled", None) if stop.is_set() else ("failed", f"{type(e).__name__}: {e}")
            finally:
                self.spark.sparkContext.removeJobTag(run_id)
            self._mark(run_id, status, error)

    def cancel(self, run_id: str) -> bool:
        """Ends a run that has not ended: its Spark jobs now, its driver code at its next checkpoint. False if there is nothing to end."""
        thread = self._threads.get(run_id)
        if thread is None or not thread.is_alive():
            return False
        self._stops[run_id].set()
        self.spark.sparkContext.cancelJobsWithTag(run_id)
        return True

    def wait(self, run_id: str, seconds: float | None = None) -> bool:
        """Whether the run has ended by then."""
        self._threads[run_id].join(seconds)
        return not self._threads[run_id].is_alive()
