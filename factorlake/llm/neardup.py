"""Near duplicates by SetSketch registers, bands, a joint likelihood and a check on full sets.

A document is the set of its distinct five-word shingles (64-bit hashes). Each
of 72 registers holds the exponent of a truncated minimum, floor(1 - log_b h)
for the least exponential hash h, so sketches merge by maximum and registers
of similar sets agree. Documents with equal sets become one node. Bands of
three registers bring nodes together; in a bucket every node is paired with
its most central one, the registers' likelihood drops pairs that can hardly
reach the threshold, and the rest are confirmed on full sets. Where a bucket
then still holds nodes of several components, the nodes outside its pivot's are
paired with all nodes of other components that an exact bound on what they can
share leaves in, likewise: after that any two nodes that share a bucket are
connected, tested or ruled out. Nothing is capped.

Components come from large-star / small-star rounds over the confirmed links.

Nodes are told apart by a 64-bit hash of their set. Edge cases: null and empty
texts, and texts of white space, have no shingles and stay alone; fewer than
five words make one shingle; repeated rows share a node; a null doc_id counts
as no id, so a group of such rows has a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm import session
from factorlake.llm.bytesblock import Rolling, blocks, mix, spread, sql_long, utf8

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
SMALL = 32  # nodes of a bucket whose pairs are few without a bound
RARE = 8  # nodes that have a rare shingle
SLACK = 12.0  # log-likelihood below the maximum at which a pair is given up: about five standard deviations

_rng = np.random.Generator(np.random.PCG64(99))
_A = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_C = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of texts, and the number of words of each text."""
    inside = ~_SPACE[body]
    before = np.append(False, inside[:-1])
    after = np.append(inside[1:], False)
    filled = offs[:-1][np.diff(offs) > 0]
    before[filled] = False
    ends = offs[1:][np.diff(offs) > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offs))


def shingles(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has."""
    starts, stops, count = words(body, offs)
    hashed = Rolling(_LOWER[body])(starts, stops)
    first = np.cumsum(count) - count
    long = np.maximum(count - WORDS + 1, 0)
    at = spread(first, long)
    value = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        value += hashed[at + k] * _C[k]
    value = mix(value)
    out, sizes, done = [], np.zeros(len(count), np.int64), 0
    for i in range(len(count)):
        if long[i]:
            own = np.sort(value[done : done + long[i]])
            own = own[np.append(True, own[1:] != own[:-1])]
            done += long[i]
        elif count[i]:
            w = hashed[first[i] : first[i] + count[i]]
            own = mix((w * _C[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def registers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SetSketch registers, a row for each non-empty set."""
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    for k in range(REGISTERS):
        least = np.minimum.reduceat(hashes * _A[k] + _B[k], starts)
        h = -np.log1p(-(least.astype(np.float64) + 1.0) / 2.0**64 * (1 - 1e-16)) / RATE
        out[:, k] = np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offs = utf8(batch.column("text"))
        for i, j, b, o in blocks(body, offs):
            hashes, sizes = shingles(b, o)
            full = np.flatnonzero(sizes)
            node = np.zeros(len(sizes), np.int64)
            regs = np.full(len(sizes), None, object)
            if len(full):
                starts = np.cumsum(sizes[full]) - sizes[full]
                node[full] = sql_long(mix(np.add.reduceat(mix(hashes), starts) + sizes[full].astype(np.uint64)))
                regs[full] = [r.tobytes() for r in registers(hashes, sizes)]
            rest = [batch.column(c).slice(i, j - i) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(sizes), pa.array(node, mask=sizes == 0), pa.array(list(regs), pa.binary())], names=["doc_id", "th", "n", "node", "regs"]
            )


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)


_GRID = np.linspace(0.0, 1.0, 101)


def may_reach(left: np.ndarray, right: np.ndarray, n1: np.ndarray, n2: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the registers' joint likelihood at some similarity >= threshold comes within SLACK of its maximum."""
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(u / v, v / u)
    j = top[:, None] * _GRID[None, :]
    plus, minus = _p(u[:, None] - v[:, None] * j), _p(v[:, None] - u[:, None] * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = sum(np.where(c[:, None] > 0, c[:, None] * np.log(np.maximum(q, 1e-12)), 0.0) for c, q in ((more, plus), (less, minus), (left.shape[1] - more - less, 1 - plus - minus)))
    # The grid ends at the largest possible similarity; a half step keeps the threshold itself in.
    able = np.where(j >= threshold - 0.5 * top[:, None] / 100, like, -np.inf).max(axis=1)
    return able >= like.max(axis=1) - SLACK


def _likely(threshold: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r1", "r2"))
                n1, n2 = (batch.column(c).to_numpy().astype(float) for c in ("n1", "n2"))
                yield batch.filter(pa.array(may_reach(left, right, n1, n2, threshold))).select(["a", "b", "d1", "h1", "d2", "h2"])

    return kernel


def _confirm(threshold: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                (s1, n1), (s2, n2) = (shingles(*utf8(part.column(c))) for c in ("t1", "t2"))
                e1, e2 = np.cumsum(n1), np.cumsum(n2)
                for k in range(part.num_rows):
                    both = np.concatenate((s1[e1[k] - n1[k] : e1[k]], s2[e2[k] - n2[k] : e2[k]]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good[i + k] = 100 * shared >= threshold * (len(both) - shared)
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return kernel


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the pairs (x, y, a, b) of nodes x and y that reach the threshold; partitioned by x already where the caller can."""
    side = lambda x, k: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"), F.col("rep.doc_id").alias(f"d{k}"), F.col("rep.th").alias(f"h{k}"))
    both = pairs.join(side("x", 1), "x").join(side("y", 2), "y").filter(f"100 * least(n1, n2) >= {threshold} * greatest(n1, n2)")
    likely = both.select("a", "b", "n1", "n2", "r1", "r2", "d1", "h1", "d2", "h2").mapInArrow(_likely(threshold / 100), "a long, b long, d1 long, h1 long, d2 long, h2 long")
    likely = session.cut(likely)
    # The texts are dealt out by th once and met twice.
    one = likely.join(texts.select(F.col("doc_id").alias("e"), F.col("th").alias("h1"), F.col("text").alias("t1")), "h1").filter("d1 <=> e").drop("e", "d1", "h1")
    two = one.join(texts.select(F.col("doc_id").alias("e"), F.col("th").alias("h2"), F.col("text").alias("t2")), "h2").filter("d2 <=> e")
    return session.cut(two.select("a", "b", "t1", "t2").mapInArrow(_confirm(threshold), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of links (a, b) between different nodes: comp is the component's least node.

    Large-star and small-star rounds until what is left is stars about their
    least node; the check for that is one grouping, not a round of its own.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # u's larger neighbours point to u's least one; u itself does so from the neighbours' side.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = session.cut(small)
        ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("below")).union(edges.select("v", F.lit(0)))
        if ends.groupBy("w").agg(F.sum("below").alias("k"), F.count(F.lit(1)).alias("n")).filter("k > 1 or (k = 1 and n > 1)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _own_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offs = utf8(batch.column("text"))
        for i, j, b, o in blocks(body, offs):
            hashes, sizes = shingles(b, o)
            take = pa.array(np.repeat(np.arange(i, j), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(take), pa.array(sql_long(hashes))], names=["node", "shingle"])


def _across(grouped: DataFrame, pivots: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (x, y) of one bucket and two components (a, b) that may reach the threshold, without those of a pivot.

    grouped has a row for each node of a bucket: node, n, rep, bands (band, m),
    comp. Of each bucket the nodes outside its pivot's component meet those of
    other components: all of them in buckets up to SMALL. In larger ones shingles are
    told apart by how many such nodes have them. Two sets without a common rare
    shingle (of at most RARE nodes) share at most the other shingles of either,
    which rules out, exactly, what a heavily edited copy can't reach. Of sets
    with a common rare shingle the rarest that they share is among the
    n - ceil(threshold * n) + 1 rarest of either, so those few are listed for
    each node, and nodes meet through the lists of those that hold them.
    """
    each = grouped.select("node", "n", "comp", F.transform("bands", lambda b: b["band"]).alias("of"), F.explode("bands").alias("b")).select("node", "n", "comp", "of", "b.band", "b.m")
    kinds = each.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("band")
    mixed = session.cut(each.join(kinds, "band").join(pivots, "band"))
    part = threshold / 100
    large = mixed.filter(F.col("m") > SMALL).select("node").distinct()
    those = session.cut(grouped.join(large, "node").select("node", "comp", "n", "rep").dropDuplicates(["node"]))
    own = those.select("node", "rep.doc_id", "rep.th").join(texts.withColumnRenamed("doc_id", "e"), "th").filter("doc_id <=> e")
    own = session.cut(own.select("node", "text").dropDuplicates(["node"]).mapInArrow(_own_shingles, "node long, shingle long"))
    few = session.cut(own.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter(F.col("df") <= RARE))
    # Only rare shingles of several nodes meet their holders: one's own names its node already, and frequent ones are what is left of n.
    each_rare = own.join(few.filter("df > 1").select("shingle", "df"), "shingle").select("node", "shingle", "df").unionByName(few.filter("df = 1"))
    # Per node: shingles that are not rare (c), those of it alone, and the rare ones it shares, rarest first.
    rare = F.when(F.col("df") > 1, F.struct("df", "shingle"))
    per_node = each_rare.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("df") == 1).cast("long")).alias("alone"), F.array_sort(F.collect_list(rare)).alias("rare"))
    per_node = those.select("node", "comp", "n").join(per_node, "node", "left").fillna(0, ["k", "alone"]).withColumn("c", F.col("n") - F.col("k"))
    first = F.greatest(F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / F.lit(100)) + F.lit(1) - F.col("alone"), F.lit(0)).cast("int")
    per_node = session.cut(per_node.select("node", "comp", "n", "c", F.slice("rare", F.lit(1), first).alias("rare")))
    # A set with too few shingles that are not rare is beyond the bound whatever its partner; a small bucket bounds by set sizes alone.
    bound = per_node.filter(100 * F.col("c") >= threshold * F.col("n")).select("node", "c")
    rows = mixed.filter(F.col("m") <= SMALL).withColumn("c", F.col("n")).unionByName(mixed.filter(F.col("m") > SMALL).join(bound, "node"))
    main = F.col("comp") == F.col("main")
    outside = rows.filter(~main).select("band", F.col("node").alias("x"), F.col("comp").alias("a"), F.col("n").alias("nx"), F.col("c").alias("sx"), F.col("of").alias("ox"), "pivot")
    other = rows.select(F.col("band").alias("bucket"), F.col("node").alias("y"), F.col("comp").alias("b"), F.col("n").alias("ny"), F.col("c").alias("sy"), F.col("of").alias("oy"), main.alias("main"))
    most = F.least("sx", "sy")
    able = (F.col("a") != F.col("b")) & (F.col("x") != F.col("pivot")) & (F.col("y") != F.col("pivot")) & (F.col("main") | (F.col("x") < F.col("y"))) & (100 * most >= threshold * (F.col("nx") + F.col("ny") - most))
    # A pair that shares many buckets is made in the least of them; a node has at most BANDS.
    once = F.array_min(F.array_intersect("ox", "oy")) == F.col("band")
    found = outside.join(other, (F.col("band") == F.col("bucket")) & able & once).select("x", "y", "a", "b")
    # At most RARE nodes hold a rare shingle; shingles of one passage have one list of holders.
    lists = per_node.select(F.struct("node", "comp", "n").alias("e"), F.explode("rare").alias("s")).groupBy("s.shingle").agg(F.array_sort(F.collect_list("e")).alias("held")).select("held").filter(F.size("held") > 1).distinct()
    one = lists.select("held", F.posexplode("held").alias("at", "e"))
    two = one.select("e", F.explode(F.slice("held", F.col("at") + F.lit(2), F.size("held"))).alias("f"))
    by_rare = two.filter((F.col("e.comp") != F.col("f.comp")) & (F.least("e.n", "f.n") >= part * F.greatest("e.n", "f.n"))).select(F.col("e.node").alias("x"), F.col("f.node").alias("y"), F.col("e.comp").alias("a"), F.col("f.comp").alias("b"))
    return session.cut(found.unionByName(by_rare).dropDuplicates(["x", "y"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, th, n, comp, component_id) for each row of docs; th is xxhash64 of its text, comp null without words."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = session.cut(texts.mapInArrow(session.tidy(_sketches), "doc_id long, th long, n long, node long, regs binary"))
    nodes = session.cut(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    band = F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("regs", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS))))
    bands = nodes.select(band.alias("band"), "node")
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # Of each node in a bucket with others: its buckets (at most BANDS) and its neighbours over all of them.
    shared = bands.join(full, "band").groupBy("node").agg(F.collect_list(F.struct("band", "m")).alias("bands"), F.sum("m").alias("c"))
    grouped = session.cut(nodes.select("node", "n", "rep").join(shared, "node"))
    each = grouped.select("node", "c", F.explode("bands.band").alias("band"))
    # A bucket's pivot is its most central node, that with the most neighbours over all bands.
    pivots = session.cut(each.groupBy("band").agg(F.max_by("node", F.struct("c", "node")).alias("pivot")))
    stars = each.join(pivots, "band").filter("node <> pivot").groupBy("node").agg(F.collect_set("pivot").alias("to"))
    pairs = stars.select(F.col("node").alias("x"), F.explode("to").alias("y")).withColumns({"a": F.col("x"), "b": F.col("y")})
    comp = session.cut(components(_links(pairs, nodes, texts, threshold)))
    grouped = session.cut(grouped.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    main = pivots.join(grouped.select(F.col("node").alias("pivot"), F.col("comp").alias("main")), "pivot").select("band", "main", "pivot")
    # Further links join components, which few of them are.
    over = components(_links(_across(grouped, main, texts, threshold), nodes, texts, threshold)).select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
    comp = grouped.select("node", "comp").join(over, "comp", "left").select("node", F.coalesce("joined", "comp").alias("comp"))
    of_node = nodes.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    of_node = session.cut(of_node)
    # Written before the join, which can then divide the rows of a component that is everywhere.
    ids = session.cut(of_node.groupBy("comp").agg(F.min("least").alias("component_id")))
    of_node = of_node.join(ids, "comp").select("node", "comp", "component_id")
    # Rows without a set would all meet under null: each keeps a key of its own.
    alone = rows.filter("n = 0").select("doc_id", "th", "n", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").select("doc_id", "th", "n", "node").join(of_node, "node").select("doc_id", "th", "n", "comp", "component_id").unionByName(alone)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, that of the least doc_id; those without words all stay."""
    session.bounded_batches(spark)
    key = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("th").alias("__th")]
    found = near_duplicates(docs).filter("doc_id <=> component_id")
    one = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.*").withColumn("__one", F.lit(True))
    rest = found.filter("comp is null").select("doc_id", "th").distinct().withColumn("__one", F.lit(False))
    keep = session.cut(one.unionByName(rest).select(*key, "__one"))
    names = ["__id", "__none", "__th"]
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), "__none": F.col("doc_id").isNull(), "__th": F.xxhash64(F.coalesce("text", F.lit("")))})
    rows = rows.join(keep.hint("shuffle_hash"), names)
    # Of rows that repeat id and text one stays; they are in one task already, as the join dealt them out by the same keys.
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("__id"))
    return rows.withColumn("__nth", nth).filter("__nth = 1 or not __one").select(*docs.columns)
