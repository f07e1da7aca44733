import random
import re

import numpy as np

from factorlake.llm import neardup


def brute(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    text = lambda n: [rnd.choice("lorem ipsum Dolor sit amet é日 x y z".split()) + str(rnd.randint(0, 60)) for _ in range(n)]
    rows, k = [], 0
    for _ in range(25):
        base = text(rnd.randint(30, 200))
        for copy in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(copy * rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.random())
            rows.append((k, rnd.choice([" ", "\n", " \t"]).join(w)))
            k += 3
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one TWO "), (1005, "one two three four"), (rows[0][0], rows[0][1]), (None, rows[5][1]), (None, "alone alone a b c d"), (1006, "a b c d e " * 3000)]
    return rows


def test_components_against_brute_force(spark):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_large_groups_of_unequal_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    rnd = random.Random(12)
    base = [f"w{rnd.randint(0, 90)}" for _ in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 400)}"
        rows.append((k, " ".join(w)))
    rows += [(500 + k, rows[40][1] + " tail" * k) for k in range(4)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n", "component_id").collect()
    assert len({c for *_, c in got}) > 3
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def joined_rows(spark, key, since):
    """Rows that joins by key made in the queries numbered since or later, and the number of the next one."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran, made = store.executionsList(), 0
    ids = [ran.apply(i).executionId() for i in range(ran.size())]
    for e in (e for e in ids if e >= since):
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and f"[{key}#" in node.desc():
                ms = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in ms if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made, max(ids, default=-1) + 1


def test_frequent_shingles_meet_no_holders(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        rows.append((k, " ".join(w)))
    _, since = joined_rows(spark, "shingle", 0)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert 10 * joined_rows(spark, "shingle", since)[0] < sum(n for _, n, _ in got)


def test_chain_of_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201)], "a long, b long")
    got = {r.node: r.comp for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, th int, comp int")
    kept = [r.doc_id for r in neardup.stage(spark, df, "").collect()]
    want = {c for d, n, c in brute(rows) if n and c is not None}
    assert {d for d in kept if d not in (1000, 1001, 1002)} - {None} == want
    assert len([d for d in kept if d is not None]) == len(set(kept) - {None})


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = x[:2000], x[1000:]
    ra, rb, ru = (neardup.registers(s, np.array([len(s)]))[0] for s in (a, b, x))
    assert (np.maximum(ra, rb) == ru).all()
    assert 0.15 < (ra == rb).mean() < 0.55
    size = lambda s: np.array([float(len(s))])
    assert not neardup.may_reach(ra[None], rb[None], size(a), size(b), 0.75)[0]
    assert neardup.may_reach(ra[None], ra[None], size(a), size(a), 0.75)[0]
