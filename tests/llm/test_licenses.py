"""Operator 7 against plain Python regexes."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses
from millrace.llm.license_rules import rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def expected(text):
    words = WORD.findall(lower(text or ""))
    base = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    norm = " " + " ".join(words) + " "
    found = set()
    for label, keyword, priority, score, regex in rules():
        if licenses.american(keyword) in licenses.american(norm):
            for m in re.finditer(f"(?<= )(?:{regex})(?= )", norm):
                first = norm[: m.start()].count(" ") - 1
                found.add((first, first + m[0].count(" "), label, priority, score))
    left = [
        d
        for d in found
        if not any(o[0] <= d[0] and o[1] >= d[1] and (o[3] < d[3] or (o[3] == d[3] and o[1] - o[0] > d[1] - d[0])) for o in found)
    ]
    labels = {label for _, label in base} | {d[2] for d in left}
    at = [i for i, _ in base]
    score = 1.0 if base else max([d[4] for d in left], default=0.0)
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


TEXTS = [
    None, "", "   ", "x", "MIT", "under the MIT License", "Under--the, mit\nlicense.", "under the mit license under the mit license", "cc by nc cc by nc cc by nc",
    "CC-BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "Apache License, Version 2.0", "the apache license version 2", "SPDX-License-Identifier: Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later", "under the ünder the mit license mit licenses",
    "All rights reserved. Copyright (c) 2020-2021", "released into the public domain", "apache licenseversion 2", "Kelvin K under the mİt license", "copyright ſ",
    "mit der Lizenz", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "word " * 4000 + "under the mit license " * 300, "1 2 3", "é É under the mit licensé",
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS)], "doc_id int, text string, labels string, n_words string")
    got = licenses.digest(licenses.scan(df, keep=["doc_id"])).collect()
    for r in got:
        assert tuple(r)[1:] == expected(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_documents(documents, odd_documents):
    for df in (documents, odd_documents):
        got = Counter(tuple(r) for r in licenses.digest(licenses.scan(df, keep=["doc_id"])).collect())
        assert got == Counter((d, *expected(t)) for d, t in df.select("doc_id", "text").collect())


def test_every_rule_is_reached_and_gated():
    words = set(licenses.gate_words([r[1] for r in rules()]))
    assert all(words & set(r[1].split()) for r in rules())
    assert 200 <= len(rules())
    for _, keyword, priority, score, regex in rules():
        assert 1 <= priority <= 5 and 0 < score <= 1 and keyword == keyword.lower()
        re.compile(regex)


def alternatives(parsed):
    """Texts that a parsed regex matches: every branch, each optional part with and without, one character of a set."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = [chr(v) if str(o) == "LITERAL" else chr(v[0]) for o, v in value]
        elif name == "ANY":
            more = ["x"]
        elif name == "BRANCH":
            more = [a for b in value[1] for a in alternatives(b)]
        elif name == "SUBPATTERN":
            more = alternatives(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = alternatives(value[2])
            more = [""] * (value[0] == 0) + [a * max(value[0], 1) for a in one]
        else:
            assert name == "ASSERT_NOT", name
            more = [""]
        # longer lists would only repeat what some of their parts show
        out = [a + b for a in out for b in more][:4000]
    return out


def test_every_alternative_holds_its_keyword_and_passes_the_gate():
    gate = set(licenses.gate_words([*(r[1] for r in rules()), *licenses.PHRASES]))
    for label, keyword, _, _, regex in rules():
        for text in alternatives(re._parser.parse(regex)):
            assert licenses.american(keyword) in licenses.american(text), (label, text)
            assert gate & set(text.split()), (label, text)


@pytest.mark.parametrize("n", [1, 500])
def test_british_spelling_and_many_detections(spark, n):
    texts = ["GNU General Public Licence version 3. ", "Mozilla Public Licence, ", "creative commons attribution non commercial share alike 4.0 ", "gpl3 or lgpl2 1 ", "licence mit sous licence x under the mit license "]
    whole = [t * n for t in texts] + ["".join(texts) * n]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(whole)], "doc_id int, text string")
    for r in licenses.digest(licenses.scan(df, keep=["doc_id"])).collect():
        want = expected(whole[r["doc_id"]]) if n == 1 else (*[n * x for x in expected(whole[r["doc_id"]][: len(whole[r["doc_id"]]) // n])[:2]], *expected(whole[r["doc_id"]][: len(whole[r["doc_id"]]) // n * 2])[4:])
        got = tuple(r)[1:] if n == 1 else (*tuple(r)[1:3], *tuple(r)[5:])
        assert got == want and r["labels"]


def test_phrases_that_overlap_themselves(spark):
    df = spark.createDataFrame([(1, "a b a b a, it's c"), (2, "license")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(df, phrases={"a b a": "x", "it s": "y'z"})).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 5, "x,y'z") and got[2]["n_base"] == 0


def test_kept_columns_and_names(odd_documents):
    got = licenses.scan(odd_documents.withColumn("N_Words", F.lit(1)).withColumn("detections", F.lit(2)))
    assert got.columns[-2:] == ["_n_words", "_detections"] and got.count() == odd_documents.count()
    assert licenses.scan(odd_documents.limit(0)).count() == 0


def test_no_python_in_the_plan(documents):
    plan = licenses.digest(licenses.scan(documents))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|Exchange|Join", plan)
