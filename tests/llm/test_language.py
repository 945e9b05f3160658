from __future__ import annotations

import random
import zlib

import cases
import numpy as np

from recollect.llm import language

LANGS = {"en": ["the", "and", "ing", "tion", "wh", "th", "er", "on"], "de": ["der", "und", "sch", "ich", "ein", "ung", "ü", "ö"],
         "es": ["el", "que", "ción", "ado", "os", "ñ", "ll", "rr"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(LANGS[lang], k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def plain(text):
    """The text's vector by the definition, one trigram after the other."""
    word, total = [], np.zeros(language.WIDTH)
    v = language.letter_vector
    for c in (text or "") + " ":
        if c.isalpha():
            word.append(ord(c.lower()))
        elif word:
            w = [language.EDGE, *word, language.EDGE]
            for a, b, d in zip(w, w[1:], w[2:]):
                total += np.roll(v(a), 2).astype(int) * np.roll(v(b), 1) * v(d)
            word = []
    return total


def test_bundles_follow_the_definition(monkeypatch):
    rng = random.Random(1)
    for rows in (30_000, 5):
        monkeypatch.setattr(language, "TABLE_ROWS", rows)
        letters = language.Letters()
        for text in [*cases.ODD, *(sentence(rng, k, 20) for k in LANGS), "ÉÀ  x1y--z"]:
            keys, counts = letters.trigrams(text or "")
            assert np.array_equal(letters.bundle(keys, counts), plain(text)), text


def test_held_out_accuracy_and_fold(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        data.append((i, sentence(rng, lang, rng.randrange(8, 40)), lang, "s", 1))
    data += [(300, None, "en", "s", 1), (301, "123 !?", "xx", "s", 1), (302, "", None, "s", 1), (None, "the and the", None, None, None), data[0]]
    docs = spark.createDataFrame(data, cases.SCHEMA).repartition(3)
    got = {(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.evaluated(docs).collect()}
    truth = {i: lang for i, _, lang, *_ in data}
    tested = [(truth[i] == lang) for i, out, lang, _ in got if i is not None and i < 300 and out]
    assert len(tested) > 60 and np.mean(tested) > 0.97
    assert all(out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, out, *_ in got if i is not None)
    assert {lang for i, _, lang, _ in got if i in (300, 301, 302)} == {"und"}
    assert all(0 <= s <= 1 for *_, s in got)
    # neither the language nor anything else of a row tells its prediction
    swapped = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 3 = 1 then 'zz' else lang end lang", "'x' source", "n_chars")
    assert {(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.evaluated(swapped).collect()} == got


def test_empty_and_untaught(spark):
    docs = cases.frame(spark, ["some text"]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r.lang_pred for r in language.evaluated(docs).collect()] == ["und"]
    assert language.evaluated(docs.limit(0)).count() == 0
