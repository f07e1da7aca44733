import random
import zlib

from pyspark.sql import functions as F

from factorlake.llm import langid, quality, toxicity


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def corpus():
    rnd = random.Random(2)
    voc = {"aa": ["the", "house", "river", "stone", "green"], "bb": ["der", "haus", "fluss", "stein", "grün"]}
    docs, labels = [], []
    for k in range(900):
        lang = rnd.choice("ab") * 2
        w = [rnd.choice(voc[lang]) + rnd.choice(["", "s", "er", "ly"]) for _ in range(rnd.randint(20, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = "grumblefool" if lang == "aa" else "dummkopf"
        good = k % 7 != 0
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w) if k % 2 else " ".join([w[0]] * len(w))
        docs.append((k, text, lang, "s", 1))
        labels.append((k, int(good), int(toxic)))
    docs += [(5000, None, "aa", "s", 0), (5001, "", "bb", "s", 0), (5002, "123 !!", None, "s", 0), (None, "the house", "aa", "s", 0), (3, docs[3][1], docs[3][2], "s", 1)]
    return docs, labels


def fold(d, m, r):
    return d is not None and zlib.crc32(str(d).encode()) % m == r


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    truth = {d: (q, t) for d, q, t in labels}
    lang = {d: x for d, t, x, *_ in docs}
    for run, modulus, rest, of in ((toxicity.op5_toxicity, 3, 1, 1), (quality.op10_quality, 5, 0, 0)):
        rows = run(spark, str(tmp_path)).collect()
        assert len(rows) == len(docs)
        assert all(r.held_out == fold(r.doc_id, modulus, rest) and 0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        wrong = [(docs[r.doc_id][1][:40], r.score) for r in held if r.predicted != truth[r.doc_id][of]]
        assert len(wrong) < 0.05 * len(held), wrong
        again = sorted((r.doc_id or -1, r.score) for r in run(spark, str(tmp_path)).collect())
        assert again == sorted((r.doc_id or -1, r.score) for r in rows)
    rows = langid.op6_language_id(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[5000].lang_pred == by[5001].lang_pred == by[5002].lang_pred == "und" and by[5000].score == 0
    held = [r for r in rows if r.held_out and r.doc_id < 5000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)


def test_word_of_few_toxic_texts_counts(spark):
    rnd = random.Random(4)
    docs = [(k, " ".join(rnd.choice(["the", "house", "river", "stone"]) for _ in range(4)) + (" grumblefool" if k % 2 and k < 48 else ""), k % 2) for k in range(17_000)]
    labels = [(k, t) for k, _, t in docs]
    # Of 17,000 labels about 5,600 of either class are learned from; 17 of those texts or so have the word.
    asked = [(20_000, "the house grumblefool river"), (20_001, "the house river")]
    docs = spark.createDataFrame([(k, t) for k, t, _ in docs] + asked, "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ["doc_id"]).filter("row.doc_id >= 20000").collect()}
    assert got[20_000] > got[20_001] + 0.05


def test_every_unlabelled_text_enters_the_risk(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 40)
    docs, labels = corpus()
    docs = [(k, t) for k, t, *_ in docs[:300]]
    labels = spark.createDataFrame([(k, q) for k, q, _ in labels[:300]], "doc_id long, quality int")
    # Of the free ids outside the held-out fold, the one that a sample by hash takes last.
    free = spark.range(1000, 1400).filter(~quality.held_out(F.col("id"), *quality.FOLD))
    last = free.orderBy(F.xxhash64(F.lit(1), "id").desc()).first().id

    def one(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return quality.score(df, labels, ["doc_id"]).filter("row.doc_id = 1").first().score

    assert one(docs) != one([*docs, (last, "||| ### |||" * 50)])


def test_nothing_to_learn_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "row"), (2, None, None)], "doc_id long, text string, score string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.row.score for r in toxicity.score(docs, labels, ["score"]).collect()] == ["row", None]
    assert quality.score(docs, labels, ["doc_id"]).count() == 2
    assert {r.lang_pred for r in langid.predict(docs, docs, ["doc_id"]).collect()} == {"und"}
    assert toxicity.score(docs.limit(0), labels, ["doc_id"]).count() == 0
    assert quality.score(docs.limit(0), labels, ["doc_id"]).count() == 0
    assert langid.predict(docs.limit(0), docs.limit(0), ["doc_id"]).count() == 0


def test_quality_of_repeated_ids_is_the_same_in_each_run(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    docs, labels = corpus()
    docs = [(k, t) for k, t, *_ in docs[:200]]
    labels = spark.createDataFrame([(k, q) for k, q, _ in labels[:200]], "doc_id long, quality int")
    again = [(k, t + " other words") for k, t in docs]

    def scores(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return {(r.row.doc_id, r.row.text): round(r.score, 9) for r in quality.score(df, labels, ["doc_id", "text"]).collect()}

    assert scores([*docs, *again]) == scores([*again[::-1], *docs])
