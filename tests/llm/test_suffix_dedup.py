import hashlib
import random
from collections import Counter

from factorlake.llm import suffix_dedup


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé日\n ") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [(k, text(rnd.randint(0, 80)) + rnd.choice(shared) + text(rnd.randint(0, 80))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 199), (103, "x" * 200), (104, "y" * 900), (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (105, "z" * 200)]
    rows += [(200 + k, rows[3][1][:300] + str(k) + rows[3][1][300:]) for k in range(12)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "1 as c0", "2 as kg")
    out = suffix_dedup.remove(df, **kw)
    assert "c0" in out.columns and "kg" in out.columns
    from pyspark.sql import functions as F

    got = out.select("doc_id", "__n_bytes", (F.col("__n_bytes") - F.octet_length("__kept")).alias("r"), F.size("__removed").alias("s"), F.sha2("__kept", 256).alias("h")).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_brute_force_by_either_way(spark):
    rows = corpus()
    want = brute(rows, 200)
    assert sum(x[2] for x in want) > 0
    assert run(spark, rows) == want
    assert run(spark, rows, hot=2) == want


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_task_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "x" * 300)], "doc_id long, text string")
    plan = suffix_dedup._repeated_ranges(suffix_dedup._keyed(docs, "doc_id", "text"), 200, 1)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # No kernel stands right above another one.
    assert any("MapInArrow" in line for line in plan) and not any("MapInArrow" in a and "MapInArrow" in b for a, b in zip(plan, plan[1:]))
