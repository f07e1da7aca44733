"""Suffix-array removal of byte substrings that occur more than once in a corpus.

A byte goes when it lies in a `length`-byte string that also starts anywhere
else (other documents or the same one); matches never cross documents.

Plan. (1) Every window of `length` bytes is dealt to its minimizer, the 64-byte
string of least hash inside it, so equal windows meet under equal minimizers and
a run of windows is one row. (2) Minimizers seen once hold no repeat and leave.
(3) Runs whose whole byte range is seen again repeat entirely. (4) The other
runs of one minimizer are cut out of their texts, one copy of each, and every
shard of them is suffix-sorted by induced sorting; positions whose permuted common
prefix reaches `length` are repeats, once their bytes have been compared. (5) Where one minimizer has over `hot` distinct
runs, its windows are counted by hash instead, a grouping that has no hot task.
Nothing is sampled: each window takes part in (3), (4) or (5).

Edge cases: null text is empty; texts under `length` bytes keep all; rows with
the same doc_id and text are documents of their own and repeat each other;
texts of any length are one block; an empty table gives no rows;
extra columns pass through `remove` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session
from factorlake.llm.bytesblock import Rolling, blocks, mix, sliding, spread, sql_long, utf8
from factorlake.llm.suffixes import repeated_starts

LENGTH = 200
SEED = 64  # bytes of a minimizer
HOT = 20_000
SHARD_BYTES = 500_000  # sorting takes some 80 times that in a Python worker
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_KEY = ["__id", "__th"]


def _runs(length: int):
    """Kernel: (id, th, text) -> one row for each run of windows with one minimizer."""
    width = length - SEED + 1

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offs = utf8(batch.column("text"))
            ids, ths = batch.column("__id"), batch.column("__th")
            for i, j, b, o in blocks(body, offs):
                sizes = np.diff(o)
                windows = np.maximum(sizes - length + 1, 0)
                if not windows.any():
                    continue
                roll = Rolling(b)
                at = spread(o[:-1], np.maximum(sizes - SEED + 1, 0))
                seeds = np.full(len(b), _NONE)
                seeds[at] = roll(at, at + SEED)
                least = sliding(np.minimum, seeds, width, _NONE)
                s = spread(o[:-1], windows)
                m = least[s]
                new = np.ones(len(s), bool)
                # The leftmost minimizer stays from one window to the next unless the value changes or it was the first byte.
                new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1) | (seeds[s[:-1]] == m[:-1])
                first = np.flatnonzero(new)
                lo, hi = s[first], s[np.append(first[1:], len(s)) - 1]
                whole = mix(roll(lo, hi + length) + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                row = np.searchsorted(o, lo, side="right") - 1
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), ths.take(take), pa.array(sql_long(m[first])), pa.array(sql_long(whole)), pa.array((lo - o[row]).astype(np.int32)), pa.array((hi - o[row]).astype(np.int32))],
                    names=["__id", "__th", "kg", "whole", "lo", "hi"],
                )

    return kernel


def _segments(length: int):
    """Kernel: texts with their runs -> the bytes of each run."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            texts, runs = batch.column("text"), batch.column("runs")
            for k in range(batch.num_rows):
                raw = (texts[k].as_py() or "").encode()
                for r in runs[k].as_py():
                    seg = raw[r["lo"] : r["hi"] + length]
                    out.append((r["kg"], r["whole"], seg))
                    held += len(seg)
                if held > 4 << 20 or k == batch.num_rows - 1:
                    if out:
                        a, b, c = zip(*out)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["kg", "whole", "seg"])
                    out, held = [], 0

    return kernel


def _as_ranges(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)])]


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _suffix_sort(length: int):
    """Kernel: segments sorted by minimizer -> ranges of repeated window starts in each."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([x[2] for x in rows], length)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([_as_ranges(x) for x in found], _RANGES)], names=["kg", "whole", "ranges"]
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for kg, whole, seg in zip(batch.column("kg").to_pylist(), batch.column("whole").to_pylist(), batch.column("seg").to_pylist()):
                if held > SHARD_BYTES and rows[-1][0] != kg:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append((kg, whole, seg))
                held += len(seg)
        if rows:
            yield solve(rows)

    return kernel


def _windows(length: int):
    """Kernel: segments -> every window start with two hashes of its bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offs = utf8(batch.column("seg"))
            for i, j, b, o in blocks(body, offs, 1 << 18):
                n = np.diff(o) - length + 1
                s = spread(o[:-1], n)
                row = np.repeat(np.arange(i, j), n)
                one = Rolling(b)(s, s + length)
                two = Rolling(b[::-1])(len(b) - s - length, len(b) - s)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kg").take(take), batch.column("whole").take(take), pa.array((s - o[row - i]).astype(np.int32)), pa.array(sql_long(one)), pa.array(sql_long(two))],
                    names=["kg", "whole", "at", "one", "two"],
                )

    return kernel


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __th, text, rest): rest has the other columns by place, so no name of theirs can clash."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    i, t = names.index(id_col), names.index(text_col)
    rest = [F.col(f"c{k}") for k in range(len(names)) if k not in (i, t)]
    text = F.coalesce(F.col(f"c{t}"), F.lit(""))
    return numbered.select(F.col(f"c{i}").cast("long").alias("__id"), F.xxhash64(text).alias("__th"), text.alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))


def _same(left: str, right: str):
    # A null doc_id is an id like any other.
    return F.col(f"{left}.__id").eqNullSafe(F.col(f"{right}.__id")) & (F.col(f"{left}.__th") == F.col(f"{right}.__th"))


def _repeated_ranges(keyed: DataFrame, length: int, hot: int) -> DataFrame:
    """(__id, __th, spans): byte ranges [a, b), unmerged, of the repeated windows of each text that has one.

    The texts are dealt out by (__id, __th) to cut the segments; `remove` deals
    them out once more in the same way, so one exchange serves both.
    """
    runs = keyed.select(*_KEY, "text").filter(F.octet_length("text") >= length).mapInArrow(session.tidy(_runs(length)), "__id long, __th long, kg long, whole long, lo int, hi int")
    # Written before the join: a join of two exchanges can divide the rows of a minimizer that is everywhere.
    shared = session.cut(runs.groupBy("kg").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kg"))
    hits = session.cut(runs.join(shared, "kg"))
    kinds = session.cut(hits.groupBy("kg", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__id", "__th", "lo", "hi")).alias("r")))
    mixed = session.cut(kinds.groupBy("kg").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    wanted = kinds.join(mixed, "kg").select("r.*", "kg", "whole", "m")

    def segments(of: DataFrame, kernel, schema: str) -> DataFrame:
        """Repeated rows give a segment twice; that only confirms a run already known to repeat whole."""
        per_doc = of.groupBy(*_KEY).agg(F.collect_list(F.struct("kg", "whole", "lo", "hi")).alias("runs"))
        return keyed.alias("d").join(per_doc.alias("w").hint("shuffle_hash"), _same("d", "w")).select("d.*", "w.runs").mapInArrow(session.tidy(kernel), schema)

    sorted_ = segments(wanted.filter(F.col("m") <= hot), _segments(length), "kg long, whole long, seg binary").repartition("kg").sortWithinPartitions("kg").mapInArrow(session.tidy(_suffix_sort(length)), "kg long, whole long, ranges array<struct<a:int,b:int>>")
    # One kernel: as two, each task would have two Python workers.
    cut, hashed = _segments(length), _windows(length)
    windows = segments(wanted.filter(F.col("m") > hot), lambda batches: hashed(cut(batches)), "kg long, whole long, at int, one long, two long")
    again = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two")
    counted = windows.join(again, ["one", "two"]).groupBy("kg", "whole").agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("ranges"))
    twice = kinds.filter("n > 1")
    all_of_it = twice.select("kg", "whole", F.array(F.struct(F.lit(0).alias("a"), (F.col("r.hi") - F.col("r.lo")).alias("b"))).alias("ranges"))
    some = sorted_.unionByName(counted).filter(F.size("ranges") > 0).join(twice.select("kg", "whole"), ["kg", "whole"], "left_anti")
    spans = hits.join(all_of_it.unionByName(some), ["kg", "whole"]).select(
        *_KEY, F.transform("ranges", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] + F.lit(length)).alias("b"))).alias("ranges")
    )
    return spans.groupBy(*_KEY).agg(F.flatten(F.collect_list("ranges")).alias("spans"))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut_out(lenient: bool):
    """Kernel: adds `n_bytes`, `removed` (merged ranges) and `kept`: the remaining bytes, or their text without characters that were cut in two."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                gone = _merge(spans.as_py()) if spans.is_valid else []
                edges = [0, *(x for ab in gone for x in ab), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(left.decode("utf-8", "ignore") if lenient else left)
                removed.append([{"a": a, "b": b} for a, b in gone])
            rest = [n for n in batch.schema.names if n not in ("text", "spans")]
            made = [pa.array(kept, pa.string() if lenient else pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, _RANGES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *made], names=[*rest, "kept", "n_bytes", "removed"])

    return kernel


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, lenient: bool = False) -> DataFrame:
    """Every row of docs but its text, with __kept (remaining bytes, or if lenient their text), __n_bytes and __removed (merged byte ranges)."""
    names = docs.columns
    keyed = _keyed(docs, id_col, text_col)
    spans = _repeated_ranges(keyed, length, hot)
    rows = keyed.alias("d").join(spans.alias("s").hint("shuffle_hash"), _same("d", "s"), "left").select("d.*", "s.spans")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text"]
    out = rows.mapInArrow(session.tidy(_cut_out(lenient)), ", ".join([*fields, f"kept {'string' if lenient else 'binary'}", "n_bytes long", "removed array<struct<a:int,b:int>>"]))
    i, t = names.index(id_col), names.index(text_col)
    columns = [(F.col("__id") if k == i else F.col(f"rest.c{k}")).alias(n) for k, n in enumerate(names) if k != t]
    return out.select(*columns, F.col("kept").alias("__kept"), F.col("n_bytes").alias("__n_bytes"), F.col("removed").alias("__removed"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove(docs)
    return out.select(
        "doc_id",
        F.col("__n_bytes").alias("n_bytes"),
        (F.col("__n_bytes") - F.octet_length("__kept")).cast("long").alias("n_removed"),
        F.size("__removed").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without what repeats; a character cut in two goes with its removed part.

    Null texts become empty, and n_chars, where there is one, follows the text. Every row stays, also one of which nothing is left.
    """
    session.bounded_batches(spark)
    out = remove(docs, lenient=True).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
