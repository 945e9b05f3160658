"""License scans (3): a positional index of rare tokens, by DataFrame functions only.

Words are runs of letters, digits and non-ASCII signs, A-Z lowered. Templates are short wordings of licences, each with
mandatory key phrases; the base phrases are templates as well. One pass over all documents counts in how many
each template word occurs; of the first key phrase of a template the two words with the highest IDF (the
rarest; of equals the earlier) become its anchors. A second pass looks up the positions of all anchors in each file,
intersects the postings of a template's two anchors by relative position, and verifies the mandatory key
phrases: the first one where it is aligned, the others anywhere in the template's place. What is left is a
place of the template, scored by the share of its words that stand there.

Both passes work row by row and shuffle nothing but one count for each template word and task.

Cases: null or empty texts and texts without words have no place (counts 0, labels empty, score 0). Repeated rows, null
ids and further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_SCORE = 0.6

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, wording, mandatory key phrases (the first one aligns the template).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted", "free of charge")),
    ("mit-notice", "released under the mit license", ("mit license", "released under")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("source and binary forms", "are permitted")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("with or without fee", "is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa", "4 0")),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright", ("associated cc0", "waived all copyright")),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]
    base: bool = False

    @property
    def offset(self) -> int:
        """Where the first key phrase stands in the wording."""
        n = len(self.keys[0])
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.keys[0])


def templates() -> list[Template]:
    base = [Template(label, tuple(p.split()), (tuple(p.split()),), True) for p, label in BASE]
    return base + [Template(label, tuple(w.split()), tuple(tuple(k.split()) for k in keys)) for label, w, keys in TEMPLATES]


def words(text: Column) -> Column:
    """Lower-case words of a text. `lower` agrees with lowering A-Z as far as ASCII words go, but for the
    Kelvin sign, which would become a k."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ⓚ")))
    return F.array_remove(F.split(plain, BETWEEN), "")


def idf(docs: DataFrame) -> dict[str, float]:
    """IDF of every template word over all documents; as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates() for w in t.words})
    held = docs.select(words(F.col("text")).alias("w")).select(F.explode(F.concat(
        F.array(F.lit("")), F.array_intersect(F.array(*map(F.lit, vocabulary)), "w"))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary}


def anchors(t: Template, weight: dict[str, float]) -> list[tuple[str, int]]:
    """The two rarest words of the first key phrase and their places in it."""
    ranked = sorted(range(len(t.keys[0])), key=lambda i: (-weight[t.keys[0][i]], i))
    return [(t.keys[0][i], i) for i in ranked[:2]]


def _array(items) -> Column:
    return F.array(*map(F.lit, items))


def _places(t: Template, weight: dict[str, float]) -> Column:
    """Starts of the first key phrase, as far as all key phrases are there."""
    postings = [F.transform(F.filter("hits", _is(word)), _moved(at)) for word, at in anchors(t, weight)]
    starts = postings[0] if len(postings) == 1 else F.array_intersect(*postings)
    first = t.keys[0]
    found = F.filter(starts, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(first)) == _array(first)))
    for key in t.keys[1:]:
        found = F.filter(found, _holds(t, key))
    return found


def _is(word: str):
    return lambda h: h["w"] == word


def _moved(at: int):
    return lambda h: h["i"] - at


def _holds(t: Template, key: tuple[str, ...]):
    """Whether a key phrase stands somewhere in the template's place, give or take its own length."""
    def check(s):
        low = F.greatest(s - t.offset - len(key), F.lit(0))
        high = s - t.offset + len(t.words) + len(key)
        return F.exists(F.sequence(low, F.greatest(high - len(key), low)), lambda k: F.slice("words", k + 1, len(key)) == _array(key))

    return check


def _share(t: Template):
    """The share of the wording that stands at a place."""
    def share(s):
        same = F.filter(F.sequence(F.lit(0), F.lit(len(t.words) - 1)),
                        lambda k: F.coalesce(F.get("words", s - t.offset + k) == F.get(_array(t.words), k), F.lit(False)))
        return F.size(same) / F.lit(float(len(t.words)))

    return share


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, base places and found (label, places, score of each template
    with a place and a score of LEAST_SCORE or more)."""
    weight, every = idf(docs), templates()
    marks = sorted({w for t in every for w, _ in anchors(t, weight)})
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words(F.col("text")))).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*marks))
    some = F.arrays_overlap("words", _array(marks))
    held = split.select("doc_id", "words", F.explode(F.array(F.when(some, hits))).alias("hits"))
    none = F.array().cast("array<struct<label:string,base:boolean,places:array<int>,score:double>>")

    def one(t: Template) -> Column:
        def told(p):
            best = F.coalesce(F.array_max(F.transform(p, _share(t))), F.lit(0.0))
            return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), p.alias("places"), best.alias("score"))

        return F.transform(F.array(_places(t, weight)), told)

    found = F.filter(F.concat(*[one(t) for t in every]), lambda r: (F.size(r["places"]) > 0) & (r["score"] >= LEAST_SCORE))
    return held.select("doc_id", F.size("words").cast("long").alias("n_words"),
                       F.when(F.col("hits").isNotNull() & (F.size("hits") > 0), found).otherwise(none).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("found", lambda r: r["base"])
    places = F.flatten(F.transform(base, lambda r: r["places"]))
    label = lambda rows: F.array_join(F.sort_array(F.array_distinct(F.transform(rows, lambda r: r["label"]))), ",")
    return scanned(docs).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), label(base).alias("base_labels"), label(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda r: r["score"])), F.lit(0.0)).alias("score"))
