"""The classifiers' numbers against a few lines of plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from factorlake.llm import langid, quality, toxicity
from factorlake.llm.bytesblock import char_grams, utf8
from factorlake.llm.linear import lbfgs


def texts_of_two_languages():
    rnd = random.Random(6)
    voc = {"aa": ["the", "house", "river", "stone"], "bb": ["der", "grün", "fluss", "straße"]}
    learn = [(" ".join(rnd.choice(voc[x]) for _ in range(6)), x) for x in ("aa", "aa", "bb") * 12]
    return learn, ["the stone", "grün", "der river", "zzz", "fluss house der"]


def plain_grams(text, lengths, ends):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    t = f" {t} " if ends else t
    return [t[i : i + n] for n in lengths for i in range(len(t) - n + 1)]


def bucket_of(gram, bits):
    """One n-gram by itself has the bucket that it has inside any text."""
    return int(char_grams(*utf8(pa.array([gram])), (len(gram),), bits)[0][0])


def test_grams_are_of_characters():
    texts = ["Grüße aus Ölbronn", "日本語のテキスト", "", "a", "mixed ÉÀ 日本 text 😀😀"]
    for ends in (False, True):
        got, count = char_grams(*utf8(pa.array(texts)), (2, 3), 16, ends)
        at = np.append(0, np.cumsum(count))
        for k, t in enumerate(texts):
            assert got[at[k] : at[k + 1]].tolist() == [bucket_of(g, 16) for g in plain_grams(t, (2, 3), ends)]


def test_toxicity_ratios_and_model_against_plain_python(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(160):
        w = [rnd.choice(["river", "stone", "grün", "日本", "house"]) for _ in range(8)]
        if k % 2:
            w[rnd.randrange(8)] = "grumble" if rnd.random() < 0.9 else "house"
        rows.append((k, " ".join(w), k % 2))
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    sizes = {0: 800, 1: 80}
    bucket, weights, bias = toxicity.fit(sample, sizes)
    sets = []
    for _, t, _ in rows:
        grams = [bucket_of(g, toxicity.BITS) for g in plain_grams(t, toxicity.LENGTHS, True)]
        sets.append({int(toxicity._level(g, k)) for g in grams for k, least in enumerate(toxicity.LEVELS) if grams.count(g) >= least})
    scale = {}
    for g in set().union(*sets):
        df = [sum(g in s for s, (*_, y) in zip(sets, rows) if y == c) for c in (0, 1)]
        stat = 2 * sum(d * math.log(d / (sum(df) / 2)) for d in df if d)
        if sum(df) >= 4 and stat > toxicity.CLEAR**2:
            scale[g] = math.log((df[1] + 0.5) / 81) - math.log((df[0] + 0.5) / 81)
    assert bucket.tolist() == sorted(scale)
    weight = {c: sizes[c] / 880 / 80 for c in (0, 1)}

    def loss(beta, b):
        out = toxicity.PENALTY / 2 * sum((x / scale[g]) ** 2 for g, x in beta.items())
        for s, (*_, y) in zip(sets, rows):
            z = b + sum(beta[g] for g in s if g in beta)
            out += weight[y] * (math.log1p(math.exp(z)) - y * z)
        return out

    found = dict(zip(bucket.tolist(), weights.tolist()))
    best = loss(found, bias)
    for _ in range(60):  # no step from there is better by more than the fit's tolerance
        g = rnd.choice(list(found))
        assert loss(found | {g: found[g] + rnd.choice([-0.2, 0.2])}, bias) > best - 1e-5
    assert min(loss(found, bias - 0.2), loss(found, bias + 0.2)) > best - 1e-5


def test_logistic_gradient():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 4, 12)
    place = rng.integers(0, 5, size.sum())
    label, weight, scale, beta = rng.integers(0, 2, 12), np.array([0.3, 0.7]), rng.normal(size=5), rng.normal(size=6)
    at = lambda b: toxicity.logistic(label, size, place, scale, weight, b)
    for k in range(6):
        e = np.eye(6)[k] * 1e-5
        assert abs((at(beta + e)[0] - at(beta - e)[0]) / 2e-5 - at(beta)[1 + k]) < 1e-6


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    x = lbfgs(lambda x: (x @ a @ x / 2 - x.sum(), a @ x - 1), np.zeros(3), gain=1e-14)
    assert np.allclose(a @ x, 1, atol=1e-5)


def test_language_posterior_against_plain_python(spark):
    learn, ask = texts_of_two_languages()
    names, _ = langid.languages(langid.counted(spark.createDataFrame(learn, "text string, lang string")))
    assert names == ["aa", "bb"]
    counts = {n: {} for n in names}
    for t, lang in learn:
        for g in plain_grams(t, langid.LENGTHS, False):
            b = bucket_of(g, langid.BITS)
            counts[lang][b] = counts[lang].get(b, 0) + 1
    docs = spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string")
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, spark.createDataFrame(learn, "text string, lang string"), ["doc_id"]).collect()}
    for k, t in enumerate(ask):
        logs = []
        for n in names:
            total = sum(counts[n].values()) + langid.SMOOTH * (1 << langid.BITS)
            logs.append(math.log(sum(x == n for _, x in learn) / len(learn)) + sum(math.log((counts[n].get(bucket_of(g, langid.BITS), 0) + langid.SMOOTH) / total) for g in plain_grams(t, langid.LENGTHS, False)))
        sure = 1 / sum(math.exp(x - max(logs)) for x in logs)
        assert got[k][0] == names[logs.index(max(logs))] and abs(got[k][1] - sure) < 1e-3


def test_languages_by_turns_are_as_at_once(spark):
    """Five languages, in turns of two and three and in one; c and d have the same texts, so ties go to c."""
    voc = {"a": "the house", "b": "der fluss", "c": "une maison", "d": "une maison", "e": "il fiume"}
    learn = spark.createDataFrame([(f"{v} {v}", k) for k, v in voc.items()] + [(None, "e"), ("x", None)], "text string, lang string")
    docs = spark.createDataFrame(list(enumerate(["the house", "fluss", "maison", "fiume il", "", None, "123", "zz"])), "doc_id long, text string")
    by = lambda group: {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, learn, ["doc_id"], group=group).collect()}
    once = by(64)
    assert [once[k][0] for k in range(7)] == ["a", "b", "c", "e", "und", "und", "und"] and once[4][1] == 0.0
    for group in (1, 2, 3):
        some = by(group)
        assert all(some[k][0] == once[k][0] and abs(some[k][1] - once[k][1]) < 1e-12 for k in once), group


def test_risk_of_positives_and_unlabelled(spark):
    """Value, gradient and Hessian of the softplus sums by finite differences, and the risk as written out."""
    rng = np.random.default_rng(3)
    x, beta = rng.normal(size=(9, 4)), rng.normal(size=4)
    s = quality._softplus(x, beta)
    assert abs(s[0] - sum(math.log1p(math.exp(v)) for v in x @ beta)) < 1e-9
    for k in range(4):
        e = np.eye(4)[k] * 1e-5
        hi, lo = quality._softplus(x, beta + e), quality._softplus(x, beta - e)
        assert abs((hi[0] - lo[0]) / 2e-5 - s[1 + k]) < 1e-6
        assert np.allclose((hi[1:5] - lo[1:5]) / 2e-5, s[5 + 4 * k : 9 + 4 * k], atol=1e-6)
    # l(g) - l(-g) = -g: prior * E_p[l(g)] + E_u[l(-g)] - prior * E_p[l(-g)] = E_u[softplus(g)] - prior * E_p[g].
    g, prior = x @ beta, 0.4
    written = prior * np.mean(np.logaddexp(0, -g)) + np.mean(np.logaddexp(0, g)) - prior * np.mean(np.logaddexp(0, g))
    assert abs(written - (s[0] / 9 - prior * g.mean())) < 1e-9


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(5)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate((rng.normal(2, 1, 3000), rng.normal(-2, 1, 7000)))
    assert abs(quality.class_prior(p, lambda cuts: (u[None, :] >= cuts[:, None]).sum(axis=1), len(u)) - 0.3) < 0.03


def test_very_long_texts(spark):
    long = "the river " * 300_000
    docs = spark.createDataFrame([(1, long, "aa"), (2, "der fluss", "bb"), (3, "the river", "aa")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 4)], "doc_id long, quality int, toxic int")
    assert {r.row.doc_id: r.lang_pred for r in langid.predict(docs, docs, ["doc_id"]).collect()} == {1: "aa", 2: "bb", 3: "aa"}
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, labels, ["doc_id"]).collect())
    assert all(0 <= r.score <= 1 for r in quality.score(docs, labels, ["doc_id"]).collect())
