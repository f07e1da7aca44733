import hashlib
import math
import re
from fractions import Fraction

from factorlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sized(rows):
    return [(d, s, len(WORD.findall(t or "")), t or "") for d, t, s in rows]


def plain_targets(sizes):
    """Targets by sharing again and again until no source is above its ceiling."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    free, left, out = set(names), Fraction(3, 2) * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        out |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def corpus():
    rows = [(k, "w " * (k * 7 % 23), "abcd"[k % 4 if k % 3 else 0]) for k in range(400)]
    return [*rows, (7, rows[7][1], "a"), (7, rows[7][1], "a"), (500, None, "b"), (501, "", None), (None, "x y z", None), (502, "\x0bp q\tr\n", "zero"), (503, " \n", "none"), (504, "long word " * 20_000, "d")]


def run(spark, rows, **kw):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), **kw)


def test_sizes_targets_and_copies(spark):
    rows = corpus()
    sizes = {}
    for _, s, n, _ in sized(rows):
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    for cells in (50_000, 4):  # one cell for each size, and many
        got = run(spark, rows, rows_per_cell=cells).collect()
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            s = r.row.source
            assert r.size == len(WORD.findall(r.row.text or "")) and r.source_size == sizes[s]
            assert abs(r.target - float(want[s])) < 1e-6 * max(1.0, r.target)
            assert 0 <= r.copies <= 2
            taken[s] = taken.get(s, 0) + r.size * r.copies
        assert all(abs(taken[s] - float(want[s])) <= 2 * max(n for _, x, n, _ in sized(rows) if x == s) for s in sizes)


def test_copies_by_prefix_sums(spark):
    """Each document is taken once for each integer that its stretch of the summed expectations crosses."""
    rows = corpus()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = run(spark, rows, rows_per_cell=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.row.source, []).append(r)
    for source, own in by.items():
        if not own[0].source_size:
            assert all(r.copies == 0 for r in own)
            continue
        u = int(md5("null" if source is None else f"s:{source}")[:8], 16) / 2**32
        rate = own[0].target / own[0].source_size
        own.sort(key=lambda r: (-r.size, md5("null" if r.row.doc_id is None else str(r.row.doc_id)), md5(r.row.text or "")))
        for k, r in enumerate(own):
            assert r.copies == math.floor(rate * (k + 1) + u) - math.floor(rate * k + u)


def test_reruns_agree_and_empty_table(spark):
    rows = corpus()
    key = lambda df: sorted(map(str, df.selectExpr("row.doc_id", "size", "copies").collect()))
    assert key(run(spark, rows)) == key(run(spark, rows[::-1]))
    assert run(spark, []).count() == 0


def test_stage_with_clashing_names(spark):
    rows = [(k, "w " * (k % 5 + 1), "ab"[k % 2], k, "c", 9) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string, copy int")
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    assert set(map(tuple, out.collect())) <= set(rows)
