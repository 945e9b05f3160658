"""Rows for the operators' tests: prose with copies, edits, odd texts and nulls."""

from __future__ import annotations

import random
import re

BLANK_WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    out = []
    for _ in range(n):
        word = _word(rng.randrange(vocabulary))
        out.append(word + rng.choice(["", "", "", "", ".", ",", ".\n"]))
    return " ".join(out)


def _word(k: int) -> str:
    rng = random.Random(k)
    return "".join(rng.choices("abcdeéñüst", k=rng.randrange(1, 8)))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = _word(rng.randrange(10_000, 20_000))
    return " ".join(words)


ODD = ["", None, " ", "\n\n", "one", "one", "a b c d", "a b c d", "x " * 400, "é" * 50, "\x00 \x85   z", "🙂 🙂 🙂 🙂 🙂 🙂",
       "a.b.c@d..e", "…", "word " * 9]


def rows(texts: list, first: int = 0) -> list[tuple]:
    return [(first + i, t, ("en", "de", None)[i % 3], ("s0", None)[i % 2], len(t) if t else None) for i, t in enumerate(texts)]


def frame(spark, texts: list, extra: bool = False):
    """The texts as documents; with `extra`, columns whose names operators use inside, a repeated row,
    a repeated id with another text, and a row without an id."""
    made = rows(texts)
    if extra:
        made += [made[0], (made[1][0], "another text with the same id", "en", "s0", 5), (None, "no id at all here", None, None, None)]
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    if extra:
        for name in ("id", "tag", "_whole", "rid", "root", "n_words", "kept", "own", "_id", "_tag", "member"):
            df = df.withColumn(name, df.doc_id.cast("string"))
    return df


def shingles(text, width: int = 5) -> set:
    words = re.findall(BLANK_WORD, text or "")
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}
