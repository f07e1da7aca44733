import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from factorlake.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(rows):
    """The set of filters that each row fails."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {f for f, bad in (
                ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
                ("E", doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in rows)),
            ) if bad}
        )
    return out


def plain(rows, labels):
    """Every order, document by document."""
    failed, out = fails(rows), []
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        made = []
        for order in ("".join(p) for p in permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                stay = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                removed_in_all[f] += len(gone)
                made.append((part, order, step, len(stay), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
                left = stay
        out += [(*m[:-1], removed_in_all[m[-1]]) for m in made]
    return sorted(out)


def corpus(seed=2):
    r = random.Random(seed)
    words = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(160):
        text = " ".join(r.sample(words, r.choice([5, 49, 50, 60])))
        text += r.choice(["", "", " #1", " | x"]) + r.choice(["", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2]) + r.choice(["", " again" * 90])
        rows.append((k, text, r.choice(["web", "web", "news", None, ""])))
    copied = [(1000 + k, rows[k % 3][1], "web") for k in range(60)]  # copies, more than a range holds
    odd = [(2000, None, "odd"), (2001, "", "odd"), (None, rows[0][1], "odd"), (None, "alone", None), (0, rows[0][1], "odd"), (2002, "é\x0b ß　" * 40, "odd"), (2003, "long text " * 30_000, "odd"), (2004, "A" * 5 + "b" * 95, "odd"), (2005, "Z" * 6 + "é" * 94, "odd")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 1060, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return rows + copied + odd, labels


def got(spark, rows, labels):
    return sorted(map(tuple, filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame(labels, LABELS)).collect()))


def test_audit_equals_every_order_played_out(spark):
    rows, labels = corpus()
    assert got(spark, rows, labels) == plain(rows, labels)


def test_copies_across_ranges(spark):
    """One text over many ranges, beside unlike texts that share its fingerprint."""
    rows = [(k, "copy", "a") for k in range(300)] + [(k, f"own {k}", "b") for k in range(300, 340)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = F.xxhash64
    try:
        assert got(spark, rows, []) == plain(rows, [])
        filter_audit.F.xxhash64 = lambda c: F.lit(5).cast("long")
        assert got(spark, rows + [(k, "other", "b") for k in range(50, 250)], []) == plain(rows + [(k, "other", "b") for k in range(50, 250)], [])
    finally:
        filter_audit.F.xxhash64 = kept
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_query_reads_whole_tables_and_no_other_columns(spark, tmp_path):
    rows, labels = corpus(5)
    spark.createDataFrame([(*r, 1, "x", 5) for r in rows], DOCS + ", mask int, part string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    found = filter_audit.op12_filter_audit(spark, str(tmp_path))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == plain(rows, labels)


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    assert len(got(spark, [(1, None, None)], [])) == 600
