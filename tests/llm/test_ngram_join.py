from __future__ import annotations

import itertools
import random

import cases
import pytest

from recollect.llm import ngram_join as nj


def brute(docs):
    """doc -> (class id, links) over rows (doc_id, text)."""
    sets = [cases.shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    key = lambda i: (docs[i][0] is not None, docs[i][0] or 0)
    least = {}
    for i in range(len(docs)):
        r = find(i)
        least[r] = min(least.get(r, i), i, key=key)
    return sorted((str(docs[i][0]), str(docs[least[find(i)]][0]), links[i]) for i in range(len(docs)))


def made(seed):
    rng = random.Random(seed)
    texts = list(cases.ODD)
    for _ in range(40):
        text = cases.prose(rng, rng.randrange(20, 200), 4000)
        texts += [text] + [cases.edited(rng, text, rng.choice([0, 1, 1, 2, 4, 8])) for _ in range(rng.randrange(0, 4))]
    hot = cases.prose(rng, 150, 4000)
    texts += [cases.edited(rng, hot, rng.randrange(0, 3)) for _ in range(60)] + [hot] * 20
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [256, 7])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    docs = cases.frame(spark, made(block), extra=True)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in nj.join(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each_class_stays(spark):
    docs = cases.frame(spark, made(2), extra=True)
    rows = docs.collect()
    classes = {c for _, c, _ in brute([(r.doc_id, r.text) for r in rows])}
    kept = nj.keep_first(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    ids = [str(r.doc_id) for r in kept]
    # the repeated id stands for two documents, each a class of its own or not
    assert set(ids) == classes
    assert {str(r) for r in kept} <= {str(r) for r in rows}
    by_text = {}
    for r in kept:
        if cases.shingles(r.text):
            assert by_text.setdefault(frozenset(cases.shingles(r.text)), r) is r


def test_empty_table(spark):
    docs = cases.frame(spark, ["a b"]).limit(0)
    assert nj.join(docs).count() == 0 and nj.keep_first(docs).count() == 0


def test_posterior_bound():
    least = nj.least_matches()
    assert len(least) == nj.COMPARED // nj.STEP and all(a < b for a, b in zip(least, least[1:]))
    n, m = 96, least[-1]
    # by integration over the uniform prior: one match fewer is below the tolerance
    grid = [(k + 0.5) / 4000 for k in range(4000)]
    def tail(m):
        mass = [x**m * (1 - x) ** (n - m) for x in grid]
        return sum(v for x, v in zip(grid, mass) if x >= 0.8) / sum(mass)
    assert tail(m) >= nj.TOLERANCE * 0.9 and tail(m - 1) < nj.TOLERANCE * 1.1
