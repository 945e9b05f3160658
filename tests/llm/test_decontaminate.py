from __future__ import annotations

import random
import re
from collections import Counter

import cases
import pytest

from recollect.llm import decontaminate as dc


def words_of(text):
    return [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def weighted(words, width):
    c = Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return {k: n * sum(len(w.encode()) for w in k) for k, n in c.items()}


def brute(docs, items):
    out = {}
    for doc_id, text, *_ in docs:
        spans = words_of(text)
        words = [m[0] for m in spans]
        for item_id, other in items:
            item = [m[0] for m in words_of(other)]
            if not item:
                continue
            w = min(5, len(item))
            b = weighted(item, w)
            best, n = None, 0
            for i in range(len(words) - len(item) + 1):
                a = weighted(words[i:i + len(item)], w)
                low = sum(min(a[k], b[k]) for k in a if k in b)
                s = low / (sum(a.values()) + sum(b.values()) - low)
                if s >= 0.8 - 1e-12:
                    n += 1
                    if best is None or s > best[0] + 1e-15:
                        best = (s, i)
            if best:
                i, j = best[1], best[1] + len(item) - 1
                out.setdefault((doc_id, item_id), []).append((round(best[0], 9), i, j, spans[i].start(), spans[j].end(), n))
    return {k: sorted(v) for k, v in out.items()}


def made(seed=3):
    rng = random.Random(seed)
    items = [(i, cases.prose(rng, rng.randrange(10, 80), 5000)) for i in range(30)]
    items += [(30, ""), (31, None), (32, "Just three words"), (33, items[0][1]), (34, "go go go go go go go go go"), (None, cases.prose(rng, 20, 5000))]
    texts = list(cases.ODD)
    for i in range(80):
        text = cases.prose(rng, rng.randrange(5, 150), 5000)
        for _, item in rng.sample(items[:30], 2):
            passage = cases.edited(rng, item, rng.choice([0, 0, 1, 1, 2]))
            if rng.random() < 0.3:
                passage = passage.upper().replace(" ", "\n- ")
            text = f"{text[:40]} {passage} {text[40:]}"
        texts.append(text if i % 3 else cases.prose(rng, 120, 5000))
    return texts + ["yes just, three WORDS.", "go go go go go go go go go go go"], items


@pytest.mark.parametrize("item_bytes", [1 << 22, 900])
def test_hits_equal_brute_force(spark, monkeypatch, item_bytes):
    texts, items = made()
    monkeypatch.setattr(dc, "ITEM_BYTES", item_bytes)
    docs = cases.frame(spark, texts, extra=True)
    got = {}
    for r in dc.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault((r.doc_id, r.item_id), []).append(
            (round(r.similarity, 9), r.first_word, r.last_word, r.start, r.end, r.n_windows))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    # upper case of ASCII letters only counts as equal, so compare on what the rule says
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(want) > 30 and any(s[0] < 1 for v in want.values() for s in v)


def test_clean_keeps_rows_whole(spark):
    texts, items = made(5)
    docs = cases.frame(spark, texts, extra=True)
    items = spark.createDataFrame(items, "item_id long, text string")
    hit = {r.doc_id for r in dc.hits(docs, items).collect()}
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in hit or r.text == "another text with the same id")


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(9)
    items = [(i, cases.prose(rng, n, 5000).replace("\n", " ")) for i, n in enumerate((5, 8, 9, 12, 20, 40, 77))]
    words = {i: item.split() for i, item in items}
    texts, cut = [], []
    for i, w in words.items():
        for text in (w[:-1], w[1:], w[:-2], w[1:-1], w[:-(len(w) // 6)], w[:len(w) // 2], [*w[:-2], "unseen"]):
            texts.append(" ".join(text))
            cut.append((i, [m[0] for m in words_of(texts[-1])]))
    docs = cases.frame(spark, texts)
    items_frame = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for doc_id, (_, doc) in enumerate(cut):
        for i, item in items:
            own = [m[0] for m in words_of(item)]
            if len(doc) < len(own):
                a, b = weighted(doc, 5), weighted(own, 5)
                low = sum(min(a[k], b[k]) for k in a if k in b)
                if (s := low / (sum(a.values()) + sum(b.values()) - low)) >= 0.8 - 1e-12:
                    want[doc_id, i] = (round(s, 9), 0, len(doc) - 1, 1)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.last_word, r.n_windows)
           for r in dc.hits(docs, items_frame).collect() if len(cut[r.doc_id][1]) < len(words_of(items[r.item_id][1]))}
    assert got == want and len(want) > 15 and {i for _, i in want} > {4, 5, 6}
    whole = [" ".join(words[4][:-1]), " ".join(words[4][:10])]
    assert [r.text for r in dc.clean(cases.frame(spark, whole), items_frame).collect()] == whole[1:]


def test_empty_tables(spark):
    docs = cases.frame(spark, ["some words"])
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.hits(docs, items).count() == 0 and dc.clean(docs, items).count() == 1
    assert dc.hits(docs.limit(0), spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0


def test_radius_is_guaranteed():
    """Multi-index lookup finds exactly the fingerprints within the radius."""
    import numpy as np

    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, (50, 6), dtype=np.int64).astype(np.uint64)
    g = dc.Items(np.arange(50), 10, hashes, np.ones((50, 6), np.int64))
    prints = g.prints[rng.integers(0, 50, 400)].copy()
    for p in prints:
        for b in rng.choice(128, rng.integers(0, 60), replace=False):
            p[b // 8] ^= 1 << (b % 8)
    who, items = g.within(prints)
    distance = np.bitwise_count(prints[:, None, :] ^ g.prints[None]).sum(axis=2)
    assert set(zip(who.tolist(), items.tolist())) == {(a, b) for a in range(400) for b in range(50) if distance[a, b] <= dc.RADIUS}
