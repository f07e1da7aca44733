"""Licence scan: ordered signature rules behind a keyword prefilter. DataFrame functions only.

Texts are reduced to their words, one space apart. Every rule is a regular
expression over that form with a keyword that must begin at a word, a priority and a
label. Only texts with a keyword meet rules, and only rules with that keyword.
A detection that lies within another's words is dropped when the other's rule
has a higher priority, or the same and is longer. Base phrases are counted at
every place and always give their label.

Edge cases: null text is empty: no words, no labels, score 0. first_word and
last_word are null without a base phrase. Rows are independent, so repeated
rows give repeated results; texts of any length are scanned whole; an empty table
gives no rows; extra columns pass in a struct, so no name of theirs can clash. A-Z are lower-cased with lower(); beyond ASCII that
changes letters to letters, which alters no word's extent and no base phrase
(none has a k, the one ASCII letter that another capital folds to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm import session

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[tuple[str, str, int, str, float]]:
    """(keyword, pattern, priority, label, weight), most specific first.

    Families times versions times wordings; patterns see single-spaced
    lower-case words, so "2.0" is "2 0". Higher priority wins.
    """
    out: list[tuple[str, str, int, str, float]] = []

    def add(keyword: str, pattern: str, priority: int, label: str, weight: float) -> None:
        out.append((keyword, pattern, priority, label, weight))

    for short, words in (("gpl", "general public license"), ("lgpl", "(?:lesser|library) general public license"), ("agpl", "affero general public license")):
        for v in ("1", "2", "3"):
            number = rf"v?{v}(?: 0)?"
            lead = 30 + 5 * (short != "gpl")
            add("general public license", rf"{words} (?:version |v )?{number} or (?:at your option )?(?:any )?later", lead + 5, f"{short}-{v}-or-later", 0.99)
            add("general public license", rf"{words} (?:version |v )?{number} only", lead + 5, f"{short}-{v}-only", 0.99)
            add("general public license", rf"{words} (?:version |v )?{number}", lead, f"{short}-{v}", 0.97)
            add(short, rf"{short} ?{number} or later", lead + 4, f"{short}-{v}-or-later", 0.95)
            add(short, rf"{short} ?{number} only", lead + 4, f"{short}-{v}-only", 0.95)
            add(short, rf"{short} ?{number}", lead - 1, f"{short}-{v}", 0.9)
        add("general public license", words, 12 + 5 * (short != "gpl"), short, 0.9)
    for v in ("1 0", "1 1", "2 0"):
        label = "apache-" + v.replace(" ", ".")
        add("apache", rf"apache (?:software )?license (?:version |v )?{v}", 30, label, 0.99)
        add("apache", rf"apache {v}", 20, label, 0.85)
    add("apache", r"apache (?:software )?license", 10, "apache", 0.85)
    parts = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    for code, words in parts.items():
        label = "cc-" + code.replace(" ", "-")
        rank = 20 + 3 * len(code.split())
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            full = f"{label}-{v.replace(' ', '.')}"
            add("cc by", rf"cc {code} {v}", rank + 10, full, 0.98)
            add("creative commons", rf"creative commons {words}(?: international| unported| generic)? {v}", rank + 10, full, 0.98)
            add("creativecommons", rf"creativecommons org licenses {code} {v}", rank + 11, full, 0.99)
        add("cc by", rf"cc {code}", rank, label, 0.9)
        add("creative commons", rf"creative commons {words}", rank, label, 0.9)
    for wording in ("cc0 1 0", "cc0", "cc zero"):
        add("cc", wording, 15, "cc0-1.0", 0.9)
    for v in ("1 0", "1 1", "2 0"):
        add("mozilla", rf"mozilla public license (?:version |v )?{v}", 30, "mpl-" + v.replace(" ", "."), 0.99)
        add("mpl", rf"mpl {v}", 20, "mpl-" + v.replace(" ", "."), 0.9)
        add("eclipse", rf"eclipse public license (?:version |v )?{v}", 30, "epl-" + v.replace(" ", "."), 0.99)
        add("epl", rf"epl {v}", 20, "epl-" + v.replace(" ", "."), 0.9)
        add("cddl", rf"cddl (?:version |v )?{v}", 30, "cddl-" + v.replace(" ", "."), 0.97)
        add("common development", rf"common development and distribution license (?:version |v )?{v}", 30, "cddl-" + v.replace(" ", "."), 0.97)
    for v in ("1 0", "1 1", "1 2", "2 0"):
        add("eupl", rf"eupl (?:version |v ?)?{v}", 30, "eupl-" + v.replace(" ", "."), 0.97)
        add("european union public", rf"european union public licen[cs]e (?:eupl )?(?:version |v ?)?{v}", 30, "eupl-" + v.replace(" ", "."), 0.97)
    add("european union public", "european union public licen[cs]e", 10, "eupl", 0.85)
    for word, name in (("2", "2"), ("two", "2"), ("3", "3"), ("three", "3"), ("4", "4"), ("four", "4")):
        add("bsd", rf"bsd {word} clause", 30, f"bsd-{name}-clause", 0.97)
        add("bsd", rf"{word} clause bsd", 30, f"bsd-{name}-clause", 0.97)
    add("bsd", "(?:simplified|freebsd) bsd license", 25, "bsd-2-clause", 0.9)
    add("bsd", "(?:new|revised|modified) bsd license", 25, "bsd-3-clause", 0.9)
    add("bsd", "bsd licen[cs]e", 10, "bsd", 0.85)
    for word, label in (("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("expat", "mit"), ("ncsa", "ncsa"), ("artistic", "artistic"), ("wtfpl", "wtfpl"), ("unlicense", "unlicense"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("php", "php"), ("python", "python"), ("ruby", "ruby"), ("vim", "vim"), ("x11", "x11"), ("curl", "curl"), ("ofl", "ofl")):
        add(word, rf"(?:the )?{word} licen[cs]e", 20, label, 0.93)
        add(word, rf"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{word}", 22, label, 0.95)
        add(word, rf"released under (?:the )?(?:terms of (?:the )?)?{word}", 22, label, 0.95)
        add(word, rf"spdx license identifier {word}", 40, label, 0.99)
    for wording, label, weight in (
        ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.97),
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 0.97),
        ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 0.95),
        ("the software is provided as is without warranty of any kind", "warranty-disclaimer", 0.6),
        ("this is free and unencumbered software released into the public domain", "unlicense", 0.99),
        ("do what the fuck you want to public license", "wtfpl", 0.99),
        ("boost software license", "bsl-1.0", 0.97),
        ("open font license", "ofl", 0.95),
        ("academic free license", "afl", 0.95),
        ("open software license", "osl", 0.9),
        ("microsoft public license", "ms-pl", 0.97),
        ("open database license", "odbl", 0.95),
        ("open government licence", "ogl", 0.95),
        ("free documentation license", "gfdl", 0.95),
        ("server side public license", "sspl", 0.97),
        ("business source license", "busl", 0.97),
        ("public domain", "public-domain", 0.6),
        ("unauthorized copying", "proprietary", 0.8),
        ("proprietary and confidential", "proprietary", 0.9),
        ("no part of this publication may be reproduced", "proprietary", 0.9),
        ("may not be reproduced without permission", "proprietary", 0.9),
        ("used with permission", "permission", 0.5),
    ):
        add(wording, wording, 25, label, weight)
    add("all rights reserved", "all rights reserved", 12, "reserved", 0.8)
    for y in ("copyright c", "copyright"):
        add("copyright", rf"{y} (?:19|20)[0-9]{{2}}", 8 + len(y.split()), "copyright", 0.7)
    return out


def normalised(text: Column) -> Column:
    """' w1 w2 ... wn ', or ' ' without words."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def base_phrases(docs: DataFrame, norm: str = "norm") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (array of labels)."""
    n = F.col(norm)
    count, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in BASE:
        p = f" {phrase} "
        has = F.contains(n, F.lit(p))
        count = count + F.when(has, F.regexp_count(n, F.lit(f"(?= {phrase} )")).cast("long")).otherwise(F.lit(0).cast("long"))
        first.append(F.when(has, _spaces(F.substring_index(n, p, 1))))
        # Words after the last place: what follows it begins at a word.
        rest = _spaces(F.substring_index(n, p, -1))
        last.append(F.when(has, F.col("n_words") - rest - F.lit(len(phrase.split()))))
        labels.append(F.when(has, F.lit(label)))
    out = docs.withColumn("n_words", F.when(n == F.lit("  "), F.lit(0).cast("long")).otherwise(_spaces(n) - F.lit(1)))
    return out.withColumns({"n_base": count, "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_compact(F.array(*labels))})


REACH = 40  # words; no rule's match is longer


def detections(texts: DataFrame, table: list[tuple[str, str, int, str, float]]) -> DataFrame:
    """(key, start, end, label, weight) of distinct (key, norm) texts: kept detections, in words, end exclusive."""
    spark = texts.sparkSession
    # A table of fixed size, so it may be broadcast.
    rule = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "rule int, keyword string, pattern string, priority int, label string, weight double"))
    words = F.array(*(F.lit(k) for k in sorted({r[0] for r in table})))
    hit = texts.withColumn("keyword", F.explode(F.filter(words, lambda k: F.contains("norm", F.concat(F.lit(" "), k))))).join(rule, "keyword")
    hit = hit.withColumn("pattern", F.concat(F.lit("(?<= )(?:"), "pattern", F.lit(")(?= )"))).filter(F.expr("norm rlike pattern"))
    parts = F.arrays_zip(F.split("norm", F.col("pattern")).alias("gap"), F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)).alias("hit"))
    one = hit.select("key", "rule", "priority", "label", "weight", F.posexplode(parts).alias("pos", "part"))
    one = one.select("key", "rule", "priority", "label", "weight", "pos", _spaces(F.col("part.gap")).alias("g"), _spaces(F.col("part.hit")).alias("h"))
    so_far = Window.partitionBy("key", "rule").orderBy("pos")
    start = F.coalesce(F.sum(F.col("g") + F.coalesce("h", F.lit(0))).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("g") - F.lit(1)
    found = one.withColumn("start", start).filter(F.col("h").isNotNull()).withColumn("end", F.col("start") + F.col("h") + F.lit(1))
    found = found.groupBy("key", "start", "end", "label").agg(F.max("priority").alias("priority"), F.max("weight").alias("weight"))
    # A longer detection that holds this one starts at most REACH words before it: at most one for each of those starts and rules.
    near = Window.partitionBy("key").orderBy("start").rangeBetween(-REACH, 0)
    size = F.col("end") - F.col("start")
    held = F.collect_list(F.struct("start", "end", "priority")).over(near)
    over = F.exists("near", lambda e: (e["end"] >= F.col("end")) & ((e["priority"] > F.col("priority")) | ((e["priority"] == F.col("priority")) & (e["end"] - e["start"] > size))))
    return found.withColumn("near", held).filter(~over).select("key", "start", "end", "label", "weight")


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", table: list[tuple[str, str, int, str, float]] | None = None) -> DataFrame:
    """Columns `keep` as struct `row`, with n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score."""
    table = rules() if table is None else table
    # As a generated column the form is made once a row; a filter on a projected one would make it anew for each keyword.
    norm = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.explode(F.array(normalised(F.col(text_col)))).alias("norm"))
    may = F.lit(False)
    for k in sorted({r[0] for r in table}):
        may = may | F.contains("norm", F.lit(f" {k}"))
    based = base_phrases(norm).withColumn("may", may)
    # Texts without a keyword join nothing; each gets a key of its own, else they would meet in one task.
    key = F.when(F.col("may"), F.sha2("norm", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("row").cast("string"), F.col("n_words").cast("string")))
    rows = based.select("row", "n_words", "n_base", "first_word", "last_word", "base", key.alias("key"))
    texts = norm.withColumn("may", may).filter("may").select(F.sha2("norm", 256).alias("key"), "norm").dropDuplicates(["key"])
    found = detections(texts, table).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("weight").alias("score"))
    out = rows.join(found, "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "row", "n_words", "n_base", "first_word", "last_word", F.array_sort("base").alias("base_labels"),
        F.array_sort(F.array_union("base", F.coalesce("found", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
