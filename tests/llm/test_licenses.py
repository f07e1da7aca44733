import random
import re

from factorlake.llm import licenses


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(words) + " "
    at, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += own
        base |= {label} if own else set()
    found = {}
    for k, pattern, rank, label, weight in licenses.rules():
        if k in norm:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
                a = norm[: m.start()].count(" ") - 1
                b = a + m.group().count(" ") + 1
                r, w = found.get((a, b, label), (0, 0.0))
                found[a, b, label] = (max(r, rank), max(w, weight))
    kept = []
    for (a, b, label), (rank, w) in found.items():
        if not any(c <= a and d >= b and (r > rank or (r == rank and d - c > b - a)) for (c, d, _), (r, _) in found.items()):
            kept.append((label, w))
    labels = sorted(base | {x for x, _ in kept})
    return (len(words), len(at), min(at, default=None), max(at, default=None), sorted(base), labels, max((w for _, w in kept), default=0.0))


TEXTS = [
    None, "", "...", "cc by", "CC BY CC BY cc-by", "cc", "by", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. All rights reserved!",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2 or later", "cc by nc sa 4.0 ccby", "Creative Commons Attribution-ShareAlike 4.0",
    "All rights reserved all RIGHTS reserved all rights", "émit License", "the mit license general public license general public license", "Copyright (c) 2020 X", "BSD 3-Clause", "\x00cc\tby\n",
]


def test_against_brute_force(spark):
    rnd = random.Random(6)
    bits = [t for t in TEXTS if t] + ["foo", "bar é", "\n", "license", "version 2", "or later", "only"]
    texts = TEXTS + [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12))) for _ in range(80)] + [" ".join(["all rights reserved"] * 3000)]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(3, texts[3], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm int")
    got = licenses.scan(df, ["doc_id", "norm"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.row.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, texts[r.row.doc_id]


def test_rules_are_many_and_short():
    table = licenses.rules()
    assert len(table) > 200
    assert all(len(p.split()) <= licenses.REACH for _, p, *_ in table)


def spelled(parsed):
    """All strings of a parsed pattern, one character standing for each range."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            own = [chr(arg)]
        elif op == "IN":
            own = [chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg]
        elif op == "MAX_REPEAT":
            own = [x * n for n in {arg[0], arg[1]} for x in spelled(arg[2])]
        elif op == "SUBPATTERN":
            own = spelled(arg[3])
        else:
            assert op == "BRANCH", op
            own = [x for part in arg[1] for x in spelled(part)]
        out = [a + b for a in out for b in own]
    return out


def test_patterns_imply_their_keywords():
    for keyword, pattern, *_ in licenses.rules():
        assert all(keyword in text for text in spelled(re._parser.parse(pattern))), pattern


def test_european_union_public_licence(spark):
    texts = {"Licensed under the European Union Public Licence, version 1.2.": ["eupl-1.2"], "European Union Public License v1.1": ["eupl-1.1"], "the European Union Public Licence (EUPL) v. 1.2": ["eupl-1.2"], "EUPL 1.2": ["eupl-1.2"], "the European Union Public Licence": ["eupl"]}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.labels for r in licenses.scan(df, ["doc_id"]).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
