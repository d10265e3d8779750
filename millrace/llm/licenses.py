"""Operator 7: licence scans by ordered signature rules, in DataFrame functions alone.

A text first passes a gate, words of which every rule's keyword has one.  Of the texts that pass, A-Z are
lower-cased and words are set apart by single spaces; each rule whose keyword stands there has its regex
tried, and every match is a detection with its first and last word.  Keywords are looked for with
"licence" spelt "license", as regexes allow both.  A detection is suppressed if another one of smaller
priority number contains its interval, or one of equal priority contains it and is longer.  Detections
are passed once for that, in order of their first words and longest first, beside the farthest last word
of each priority so far; so the work grows as their number.  Labels of detections that are left are the
text's labels.

Base phrases are detections beside the rules: they are never suppressed and suppress nothing.

Everything is computed within the row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_name, text_column
from .license_rules import rules

#: Phrases that are counted wherever their words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What stands between words of a text, before or after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands before each match; no normalised text holds it.
MARK = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _anchored(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


#: Words that many keywords hold and few other texts do.
GATE_FIRST = ["license", "licenses", "licensed", "copyright", "copyrighted", "spdx", "gpl", "lgpl", "agpl", "commons", "domain", "apache", "cc"]


#: Words that a version's number may follow without a space, as in gpl3.
BEFORE_DIGIT = {"gpl", "lgpl", "agpl", "mpl", "eupl", "wtfpl", "cecill", "lppl", "license"}


def american(keyword: str) -> str:
    """A keyword with licence and its forms spelt as keywords are looked for."""
    return keyword.replace("licence", "license")


def gate_words(keywords: list[str]) -> list[str]:
    """Words such that a text in which a keyword stands as whole words, in either spelling, has one of them: a word of each keyword."""
    out = set()
    for k in map(american, keywords):
        words = k.split(" ")
        first = next((g for g in GATE_FIRST if g in words), max(words, key=len))
        out |= {first, *(f"{first}{d}" for d in "123" if first in BEFORE_DIGIT)}
    return sorted(out | {w.replace("license", "licence") for w in out})


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _literal(rows: list[tuple]) -> Column:
    """An array of rules; as one piece of SQL, as calls for each value would take seconds."""

    def written(v) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)

    fields = ("regex", "keyword", "priority", "score", "label", "more")
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{f}', {written(v)}" for f, v in zip(fields, r)) + ")" for r in rows) + ")")


#: What a detection is, in the order in which detections are sorted: back is the last word's place, negative.
DETECTION = "struct<first:bigint,back:bigint,priority:int,label:string,score:double,base:boolean,last:bigint>"


def _detection(rule: Column, first: Column, last: Column, base: bool) -> Column:
    first, last = first.cast("long"), last.cast("long")
    return F.struct(first.alias("first"), (-last).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"), F.lit(base).alias("base"), last.alias("last"))


def _places(marked: Column) -> Column:
    """Numbers of the words of a normalised text that begin with MARK."""
    return F.filter(F.transform(F.split(marked, " "), lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())


def _matches(norm: Column, rule: Column) -> Column:
    """All matches of a rule's regex in a normalised text, with the places of their first and last words."""
    places = _places(F.regexp_replace(norm, rule["regex"], F.lit(MARK + "$0")))
    sizes = F.transform(F.regexp_extract_all(norm, rule["regex"], F.lit(0)), _spaces)
    return F.zip_with(places, sizes, lambda at, more: _detection(rule, at, at + more, False))


def _phrase(norm: Column, phrase: Column) -> Column:
    """All places of a phrase, overlapping ones too."""
    return F.transform(_places(F.regexp_replace(norm, phrase["regex"], F.lit(MARK))), lambda at: _detection(phrase, at, at + phrase["more"], True))


#: Detections that are left are put together in parts of so many, as an array is copied when it grows.
PART = 128


def _survivors(found: Column, priorities: int) -> Column:
    """Detections of rules but for equal and suppressed ones, in order."""
    state = f"far:array<bigint>,before:{DETECTION},kept:boolean"

    def begin(far: Column, before: Column, kept: Column, left: Column, kind: str) -> Column:
        return F.struct(far.alias("far"), before.alias("before"), kept.alias("kept"), left.alias("left")).cast(f"struct<{state},left:{kind}>")

    def step(s: Column, d: Column) -> Column:
        alike = (s["before"]["first"] == d["first"]) & (s["before"]["last"] == d["last"]) & (s["before"]["priority"] == d["priority"])
        # what went before contains d if it ends no earlier; only its own like is no longer than d
        stays = F.when(F.coalesce(alike, F.lit(False)), s["kept"]).otherwise(F.array_max(F.slice(s["far"], 1, d["priority"])) < d["last"])
        new = ~F.coalesce(s["before"] == d, F.lit(False))
        far = F.transform(s["far"], lambda x, i: F.when(i + 1 == d["priority"], F.greatest(x, d["last"])).otherwise(x))
        return begin(far, d, stays, F.when(stays & new, F.concat(s["left"], F.array(d))).otherwise(s["left"]), f"array<{DETECTION}>")

    def part(s: Column, ds: Column) -> Column:
        made = F.aggregate(ds, begin(s["far"], s["before"], s["kept"], F.array(), f"array<{DETECTION}>"), step)
        return _let(made, lambda m: begin(m["far"], m["before"], m["kept"], F.concat(s["left"], F.array(m["left"])), f"array<array<{DETECTION}>>"))

    def passed(ds: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ds) - 1) / PART).cast("int")), lambda i: F.slice(ds, i * PART + 1, F.lit(PART)))
        nothing = begin(F.array(*[F.lit(-1)] * priorities), F.lit(None), F.lit(False), F.array(), f"array<array<{DETECTION}>>")
        return F.when(F.size(ds) > 0, F.flatten(F.aggregate(parts, nothing, part, lambda s: s["left"]))).otherwise(ds)

    return _let(F.array_sort(found), passed)


def scan(df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of df (all but the text, by default) and what the scan found in each text.

    n_words long; detections: array of struct(label, priority, score, base, first, last), not
    suppressed, in order of first and last word (words counted from 0).  A null or empty text has no
    words and no detections; equal detections of one place and label are one.  New columns whose
    names clash with kept ones get underscores in front.
    """
    phrases = PHRASES if phrases is None else phrases
    source = text_column(df, text)
    keep = [text_column(df, c) for c in keep] if keep is not None else [c for c in df.columns if c != source]
    made_rules = rules()
    signatures = _literal([(_anchored(r), american(k), p, s, label, 0) for label, k, p, s, r in made_rules])
    base = _literal([(f"(?<= )(?={p} )", american(p), 0, 1.0, label, p.count(" ")) for p, label in phrases.items()])
    body = F.coalesce(F.col(f"`{source}`"), F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.translate(F.regexp_replace(body, BETWEEN, " "), UPPER, LOWER)), F.lit(" "))
    nothing = F.array().cast(f"array<{DETECTION}>")

    def tried(n: Column, listed: Column, use: Callable[[Column, Column], Column]) -> Column:
        """What the listed rules find whose keywords stand in n."""
        here = _let(F.replace(n, F.lit("licence"), F.lit("license")), lambda a: F.filter(listed, lambda r: a.contains(r["keyword"])))
        return F.flatten(F.transform(here, lambda r: use(n, r)))

    def found(n: Column) -> Column:
        left = _survivors(tried(n, signatures, _matches), max(p for _, _, p, _, _ in made_rules))
        return F.concat(left, tried(n, base, _phrase) if phrases else nothing)

    def ordered(ds: Column) -> Column:
        """In order of first and last word and label."""
        return F.transform(
            F.array_sort(F.transform(ds, lambda d: F.struct(d["first"], d["last"], d["label"], d["priority"], d["score"], d["base"]))),
            lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["score"].alias("score"), d["base"].alias("base"), d["first"].alias("first"), d["last"].alias("last")),
        )

    empty = F.array().cast("array<struct<label:string,priority:int,score:double,base:boolean,first:bigint,last:bigint>>")
    gate = F.array(*map(F.lit, gate_words([*(r[1] for r in made_rules), *phrases])))

    def both(words: Column) -> Column:
        edges = (F.element_at(words, 1) == "").cast("long") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("long")
        return F.struct((F.size(words) - edges).alias("n"), F.when(F.arrays_overlap(words, gate), ordered(_let(norm, found))).otherwise(empty).alias("d"))

    kept = df.select(*[f"`{c}`" for c in keep])
    n_words, detections, made = (column_name(kept, c) for c in ("n_words", "detections", "made"))
    # for the gate, and for counting, all letters may be in lower case: words stay words
    each = df.select(*[f"`{c}`" for c in keep], _let(F.split(F.lower(body), BETWEEN), both).alias(made))
    return each.select(*[f"`{c}`" for c in keep], F.col(f"`{made}`.n").alias(n_words), F.col(f"`{made}`.d").alias(detections))


def digest(scanned: DataFrame, detections: str = "detections") -> DataFrame:
    """scanned with n_base, first_word and last_word (of base places), base_labels, labels and score instead of detections."""
    d = F.col(f"`{detections}`")

    def listed(ds: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda x: x["label"]))), ",")

    base = F.filter(d, lambda x: x["base"])
    first = F.transform(base, lambda x: x["first"])
    return scanned.select(
        *[f"`{c}`" for c in scanned.columns if c != detections],
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(d).alias("labels"),
        F.coalesce(F.array_max(F.transform(d, lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
