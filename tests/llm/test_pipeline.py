import hashlib
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factorlake.llm import bpe, mixing, toxicity
from tests.llm.test_classifiers import write
from tests.llm.test_neardup import brute as near
from tests.llm.test_suffix_dedup import brute as repeats


def corpus():
    import random

    rnd = random.Random(8)
    words = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(n))
    shared = words(70)
    docs, labels = [], []
    for k in range(150):
        text = words(rnd.randint(10, 90))
        if k % 6 == 0:
            text = f"{text} {shared} {words(30)}"
        if k % 4 == 0:
            text = f"{text} nastyword"
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, int(k % 4 == 0)))
    docs += [(500, docs[1][1], "en", "s1", 1), (501, docs[1][1], "en", None, 1), (502, None, "en", None, 0), (503, "", None, "s0", 0)]
    return docs, labels


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bad = {r.row.doc_id for r in toxicity.score(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), ["doc_id"]).collect() if r.score >= 0.7}
    assert bad
    now = [d for d in docs if d[0] not in bad]
    stages, out = dict(corpus_pipeline.STAGES), table
    got = []
    for name, stage in stages.items():
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got.append(out)
        if name != "bpe":
            assert out.columns == table.columns
    assert sorted(r.doc_id for r in got[0].collect()) == sorted(d[0] for d in now)
    comp = {d: c for d, _, c in near([(d[0], d[1]) for d in now])}
    now = [d for d in now if comp[d[0]] == d[0]]
    assert sorted(r.doc_id for r in got[1].collect()) == sorted(d[0] for d in now)
    want = {d: h for d, _, _, _, h in repeats([(d[0], d[1]) for d in now], 200)}
    rows = got[2].collect()
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows} == want
    assert any(len(r.text) < len(next(d[1] for d in docs if d[0] == r.doc_id) or "") for r in rows)
    copies = {r.row.doc_id: r.copies for r in mixing.mix(got[2], keep=["doc_id"]).collect()}
    assert Counter(r.doc_id for r in got[3].collect()) == Counter({d: c for d, c in copies.items() if c})
    lib = Tokenizer.from_file(bpe.model_path())
    text = {r.doc_id: r.text or "" for r in rows}
    assert all(r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids) for r in got[4].collect())
    a, b = (sorted(map(str, x.collect())) for x in (got[4], corpus_pipeline.run(spark, str(tmp_path))))
    assert a == b


def test_empty(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
