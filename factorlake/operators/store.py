"""Run and log tables, snapshot manifests, artifacts and CSV exchange.

Runs are append-only state events; a run's state is the last event's. Nothing
is updated in place, so writers need no lock.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions import workdir
from factorlake.operators.prepare import normalise

STATES = ("queued", "running", "succeeded", "failed", "canceled")
RUN_EVENT = "run_id string, at timestamp_ntz, seq long, status string, error string"


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


class RunLog:
    """Appends run state events to a Parquet folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seq = spark, path, 0

    def mark(self, run_id: str, status: str, error: str | None = None) -> None:
        if status not in STATES:
            raise ValueError(f"unknown state {status!r}")
        self.seq += 1
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(run_id, now, self.seq, status, error)], RUN_EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        return latest_runs(self.spark.read.schema(RUN_EVENT).parquet(self.path))


def latest_runs(events: DataFrame) -> DataFrame:
    """(run_id, created_at, updated_at, status, error) of each run's last event."""
    last = F.max_by(F.struct("status", "error"), F.struct("at", "seq")).alias("s")
    return events.groupBy("run_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), last).select("run_id", "created_at", "updated_at", "s.status", "s.error")


def logs_after(logs: DataFrame, run_id: str | None, after_id: int = 0, limit: int = 500) -> DataFrame:
    """The next log rows after a cursor, in order."""
    rows = logs.filter(F.col("id") > after_id)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return rows.orderBy("id").limit(min(max(limit, 1), 2000))


def content_hash(frame: DataFrame) -> DataFrame:
    """One row: a hash that depends on the rows and columns but not on their order.

    Row digests are cut in four 32-bit words and each word is summed, so the
    aggregate is partial on every task and no list of digests is gathered.
    """
    cols = sorted(frame.columns)
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in cols)), 256)
    words = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{k}") for k in range(8)]
    g = frame.agg(F.count(F.lit(1)).alias("rows"), *words)
    text = F.concat_ws(",", F.lit("|".join(cols)), F.col("rows").cast("string"), *(F.coalesce(F.col(f"w{k}").cast("string"), F.lit("0")) for k in range(8)))
    return g.select("rows", F.sha2(text, 256).alias("content_hash"))


def manifest(frame: DataFrame, run_id: str, dataset: str, provider: str, path: str) -> DataFrame:
    """One row that describes a snapshot of a bar-like frame."""
    about = frame.agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    d = content_hash(frame).crossJoin(about)
    key = F.sha2(F.concat_ws("|", F.lit(run_id), F.lit(dataset), F.lit(provider), "content_hash", F.lit(path)), 256)
    return d.select(key.alias("snapshot_id"), F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), F.lit(provider).alias("provider"), "content_hash", "rows", "symbols", "start", "end", F.lit(path).alias("artifact_path"), F.lit(",".join(sorted(frame.columns))).alias("columns"))


def snapshots(manifests: DataFrame, run_id: str | None = None, limit: int = 100) -> DataFrame:
    """Manifest rows, of one run if named, by newest data first."""
    rows = manifests if run_id is None else manifests.filter(F.col("run_id") == run_id)
    return rows.dropDuplicates(["snapshot_id"]).orderBy(F.col("end").desc_nulls_last(), "snapshot_id").limit(min(max(limit, 1), 1000))


def last_rows(artifact: DataFrame, order: list[str], limit: int = 200) -> DataFrame:
    """The last `limit` (25 to 800) rows of an artifact by `order`, in order: no row but these leaves its task."""
    n = min(max(limit, 25), 800)
    return artifact.orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(n).orderBy(*order)


def write_artifacts(frames: dict[str, DataFrame], folder: str, csv: bool = False) -> dict[str, str]:
    """Each frame as a Parquet (or CSV) folder under `folder`; returns the paths."""
    out = {}
    for name, frame in frames.items():
        out[name] = f"{folder.rstrip('/')}/{name}"
        writer = frame.write.mode("overwrite")
        writer.option("header", True).csv(out[name]) if csv else writer.parquet(out[name])
    return out


def csv_roundtrip(market: DataFrame) -> DataFrame:
    """market through header-CSV and normalisation."""
    path = workdir.fresh(market.sparkSession, "csv")
    market.write.option("header", True).csv(path)
    return normalise(market.sparkSession.read.option("header", True).csv(path))
