"""Polled snapshots as a stream: one reply set per interval, kept until Spark has committed it.

The source asks an injected `fetch(poll) -> [(inst_id, kind, payload), ...]` where
Spark plans a batch, at most once per interval. What it got is written to a folder
before Spark sees the offset, so a batch that runs again after a failure reads the
same replies: no poll is lost or doubled. Committed polls are removed. A fetch
that fails is a row of kind "error", and the next interval asks again.
"""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from factorlake.functions.numerics import number
from factorlake.operators.context import TRADES, millis, parsed

SCHEMA = "poll long, inst_id string, kind string, payload string"
EVERY_MS = 15_000
NEWEST = 80


class Poller(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Callable[[int], list[tuple[str, str, str]]], folder: str, every_ms: int):
        self.fetch, self.every_ms = fetch, every_ms
        self.fs, self.root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def _path(self, poll: int) -> str:
        return posixpath.join(self.root, f"poll-{poll:012d}.json")

    def initialOffset(self) -> dict:
        return {"poll": 0, "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = int(time.time() * 1000)
        if now - start["at"] < self.every_ms:
            return iter(()), start
        try:
            rows = [list(r) for r in self.fetch(start["poll"])]
        except Exception as e:  # the next interval asks again
            rows = [[None, "error", f"{type(e).__name__}: {e}"]]
        self.fs.create_dir(self.root, recursive=True)
        part = self._path(start["poll"]) + ".part"
        with self.fs.open_output_stream(part, compression=None) as out:
            out.write(json.dumps(rows).encode())
        self.fs.move(part, self._path(start["poll"]))
        end = {"poll": start["poll"] + 1, "at": now}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for poll in range(start["poll"], end["poll"]):
            with self.fs.open_input_file(self._path(poll)) as f:
                rows += [(poll, *row) for row in json.loads(f.read())]
        return iter(rows)  # Spark sends it on, so no generator

    def commit(self, end: dict) -> None:
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True)):
            name = posixpath.basename(info.path)
            if name.startswith("poll-") and name.endswith(".json") and int(name[5:-5]) < end["poll"]:
                self.fs.delete_file(info.path)


def source(fetch: Callable[[int], list[tuple[str, str, str]]], name: str = "polled_snapshots") -> type[DataSource]:
    """A data source class over `fetch`; options path (the folder of uncommitted polls) and every_ms."""

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> Poller:
            return Poller(fetch, self.options["path"], int(self.options.get("every_ms", EVERY_MS)))

    return Polled


def stream(spark: SparkSession, fetch: Callable[[int], list[tuple[str, str, str]]], path: str, every_ms: int = EVERY_MS, name: str = "polled_snapshots") -> DataFrame:
    spark.dataSource.register(source(fetch, name))
    return spark.readStream.format(name).option("path", path).option("every_ms", every_ms).load()


def newest_trades(polled: DataFrame, n: int = NEWEST) -> DataFrame:
    """(poll, inst_id, timestamp, price, size, side): the n newest trades of each poll over all instruments."""
    x = parsed(polled.filter("kind = 'trades'"), TRADES).select("poll", "inst_id", F.explode("p.data").alias("x"))
    rows = x.select("poll", "inst_id", millis(F.col("x.ts")).alias("timestamp"), number("x.px").alias("price"), number("x.sz").alias("size"), F.lower("x.side").alias("side"))
    # A reply holds a few dozen trades for each instrument, so a poll is small.
    order = Window.partitionBy("poll").orderBy(F.col("timestamp").desc_nulls_last(), "inst_id", "price", "size", "side")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r")
