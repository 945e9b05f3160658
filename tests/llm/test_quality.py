from __future__ import annotations

import json
import random
import re
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import flat, quality


def counted(text):
    text = text or ""
    words = re.findall(cases.BLANK_WORD, text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(cases.BLANK_WORD, line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(cover))


def texts(seed=1, n=300):
    rng = random.Random(seed)
    out = list(cases.ODD)
    for i in range(n):
        text = cases.prose(rng, rng.randrange(40, 120), 2000)
        if i % 10 == 0:
            text = re.sub(r"(\S+)", r"\1***", text)
        if i % 10 == 1:
            line = cases.prose(rng, 6, 2000).replace("\n", "")
            text = "\n".join([line, cases.prose(rng, 9, 2000)] * 6)
        out.append(text)
    return out


def test_counts_equal_brute_force():
    made = texts()
    got = quality.count_rules(*flat.flatten(pa.array(made)))
    names = [c.split()[0] for c in quality.COUNTS.split(", ")]
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(made))] == [counted(t) for t in made]


@pytest.mark.parametrize("share, k", [(0.5, 5), (0.975, 5), (0.99999, 5), (0.75, 7)])
def test_chi_squared(share, k):
    x = quality.chi2_quantile(share, k)
    grid = np.linspace(0, x, 400_001)[1:]
    mass = np.trapezoid(grid ** (k / 2 - 1) * np.exp(-grid / 2), grid)
    import math

    assert abs(mass / (2 ** (k / 2) * math.gamma(k / 2)) - share) < 1e-4


def test_mcd_is_not_pulled_by_outliers(spark):
    rng = np.random.default_rng(4)
    centre = np.array([1.8, 0.2, 0.3, 0.4, 5.0])
    scatter = np.diag([0.2, 0.1, 0.2, 0.15, 0.7]) @ (np.eye(5) * 0.7 + 0.3) @ np.diag([0.2, 0.1, 0.2, 0.15, 0.7])
    good = rng.multivariate_normal(centre, scatter, 3000)
    bad = rng.multivariate_normal(centre + 4, scatter / 9, 600)
    rows = spark.createDataFrame([("g", *map(float, r)) for r in np.concatenate([good, bad])], "grp string, " + ", ".join(f"{x} double" for x in quality.X))
    m = quality.mcd(rows).first()
    assert np.abs(np.array([m[f"m{i}"] for i in range(5)]) - centre).max() < 0.08
    precision = np.zeros((5, 5))
    for i, j in quality.PAIRS:
        precision[i, j] = precision[j, i] = m[f"p{i}{j}"] / (1 if i == j else 2)
    wanted = scatter + np.diag(np.square(quality.FLOORS))
    assert np.abs(np.linalg.inv(precision) / np.sqrt(np.outer(np.diag(wanted), np.diag(wanted)))
                  - wanted / np.sqrt(np.outer(np.diag(wanted), np.diag(wanted)))).max() < 0.2
    judged = rows.crossJoin(quality.mcd(rows).drop("grp")).select(quality._distance().alias("d")).toPandas()["d"].to_numpy()
    cut = quality.chi2_quantile(quality.CUT, 5)
    assert (judged[3000:] > cut).all() and (judged[:3000] <= cut).mean() > 0.999


def test_junk_goes_and_prose_stays(spark):
    made = texts(2, 400)
    docs = cases.frame(spark, made, extra=True)
    got = {r.doc_id: r for r in quality.judge(docs).where("doc_id >= 15").collect()}
    junk = {i for i in got if (i - len(cases.ODD)) % 10 in (0, 1)}
    assert not any(got[i].kept for i in junk) and np.mean([got[i].kept for i in set(got) - junk]) > 0.99
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got.values())
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).where("kept").count()


def test_groups_of_some_dozens_have_their_own_estimate(spark):
    rng = random.Random(6)
    made = [("en", source, cases.prose(rng, rng.randrange(*size), 2000)) for source, size, n in (
        ("a", (40, 60), 40), ("b", (900, 1100), 40), ("c", (40, 60), 10)) for _ in range(n)]
    docs = spark.createDataFrame([(i, t, lang, source, len(t)) for i, (lang, source, t) in enumerate(made)], cases.SCHEMA)
    found = {json.loads(r.own)["source"]: r for r in quality.estimates(quality.measured(docs)).collect()}
    assert abs(found["a"].m4 - np.log(50)) < 0.2 and abs(found["b"].m4 - np.log(1000)) < 0.2
    assert found["c"].m4 not in (found["a"].m4, found["b"].m4)  # ten rows: the estimate of the language
    judged = quality.judge(docs).collect()
    assert all(r.distance2 is not None for r in judged)


def test_few_and_no_rows(spark):
    few = cases.frame(spark, ["one two three four five six seven eight nine ten eleven", "short", None])
    assert sorted((r.doc_id, r.kept) for r in quality.judge(few).collect()) == [(0, True), (1, False), (2, False)]
    assert quality.judge(few.limit(0)).count() == 0 and quality.keep_good(few.limit(0)).count() == 0
