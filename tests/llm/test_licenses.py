from __future__ import annotations

import random
import re

import cases

from recollect.llm import licenses as lic


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def starts(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if tuple(words[i:i + len(phrase)]) == tuple(phrase)]


def brute(text):
    words = words_of(text)
    base = [(i, label) for phrase, label in lic.BASE for i in starts(words, phrase.split())]
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    for t in lic.templates():
        if t.base:
            continue
        best = 0.0
        for s in starts(words, t.keys[0]):
            low, high = max(0, s - t.offset - len(t.words) * 0 - 0), s - t.offset + len(t.words)
            ok = all(any(max(0, s - t.offset - len(k)) <= p <= max(high, max(0, s - t.offset - len(k))) for p in starts(words, k)) for k in t.keys[1:])
            if ok:
                at = s - t.offset
                same = sum(0 <= at + i < len(words) and words[at + i] == w for i, w in enumerate(t.words))
                best = max(best, same / len(t.words))
        if best >= lic.LEAST_SCORE:
            labels.add(t.label)
            score = max(score, best)
    places = [i for i, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None),
            ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score)


def made():
    rng = random.Random(9)
    lines = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
             "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "MIT\nLICENSE", "mit licenses", "apache-license",
             "general public", "mit worK license", "mıt license", *[w for _, w, _ in lic.TEMPLATES]]
    texts = [*cases.ODD, *lines, "mit license " * 50, "license", "K apache license İ"]
    for _ in range(150):
        bits = rng.sample(lines, rng.randrange(0, 3)) + [cases.edited(rng, rng.choice(lines), 1)]
        text = " ".join([cases.prose(rng, rng.randrange(0, 40)), *bits, cases.prose(rng, rng.randrange(0, 40))])
        texts.append(text if rng.random() < 0.7 else text.upper())
    return texts


def test_report_equals_brute_force(spark):
    docs = cases.frame(spark, made(), extra=True)
    got = sorted((str(r[0]), *map(str, r[1:])) for r in lic.report(docs).collect())
    want = sorted((str(r.doc_id), *map(str, brute(r.text))) for r in docs.collect())
    assert got == want


def test_plan_has_no_python(spark, tmp_path):
    cases.frame(spark, ["mit license"]).write.parquet(str(tmp_path / "d"))
    plan = lic.report(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert lic.report(cases.frame(spark, ["a"]).limit(0)).count() == 0
