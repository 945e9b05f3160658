from __future__ import annotations

import hashlib
import random
from pathlib import Path

import cases
import numpy as np
import pytest

from recollect.llm import substrings, suffix_array
from recollect.llm.rows import NO_ID
from recollect.session import checkpoint_dir

L = substrings.LENGTH


def brute(docs):
    """docs: distinct (key, bytes), in order of the key."""
    seen, out = {}, {}
    for key, data in docs:
        for i in range(len(data) - L + 1):
            seen.setdefault(data[i:i + L], (key, i))
    for key, data in docs:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - L + 1):
            if seen[data[i:i + L]] != (key, i):
                gone[i:i + L] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[key] = (len(data), int(gone.sum()), int((edge > 0).sum()), hashlib.sha256(kept).hexdigest())
    return out


def made(seed, n):
    rng = random.Random(seed)
    passages = [cases.prose(rng, rng.randrange(10, 60), 5000) for _ in range(5)]
    texts = [*cases.ODD, "le. " * 60, "ab" * 200, "é" * 120]
    for _ in range(n):
        texts.append(rng.choice(["", "\n"]).join([cases.prose(rng, rng.randrange(0, 60), 5000), rng.choice(passages)[rng.randrange(3):],
                                                  cases.prose(rng, rng.randrange(0, 30), 5000), rng.choice([*passages, "", ""])]))
    texts += [cases.edited(rng, rng.choice(texts[18:]), 1) for _ in range(n // 4)]
    return texts + rng.sample(texts[18:], n // 5)


@pytest.mark.parametrize("local, block, n", [(1 << 20, suffix_array.BLOCK, 60), (1 << 20, 300, 30), (3000, 999, 10)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, local, block, n):
    monkeypatch.setattr(suffix_array, "LOCAL", local)
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    docs = cases.frame(spark, made(n, n), extra=True)
    rows = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) tag").collect()
    key = lambda r: (NO_ID if r.doc_id is None else r.doc_id, r.tag)
    want = brute(sorted({(key(r), r.text.encode()) for r in rows}))
    got = sorted((str(r[0]), *r[1:]) for r in substrings.digests(docs).collect())
    assert got == sorted((str(r.doc_id), *want[key(r)]) for r in rows)
    assert sum(w[1] for w in want.values()) > 1000


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(3)
    for kind in (4, 2, 256):
        shared = rng.integers(0, kind, L, dtype=np.uint8)
        for _ in range(20):
            sides = [np.concatenate([rng.integers(0, kind, rng.integers(0, 200), dtype=np.uint8), shared, rng.integers(0, kind, 50, dtype=np.uint8)]) for _ in "ab"]
            found = []
            for s in sides:
                at = next(i for i in range(len(s) - L + 1) if (s[i:i + L] == shared).all())
                places, hashes = substrings.anchors(s)
                inside = (places >= at) & (places + substrings.ANCHOR <= at + L)
                found.append({(int(p) - at, int(h)) for p, h in zip(places[inside], hashes[inside])})
            assert found[0] & found[1]


@pytest.mark.parametrize("local, alphabet", [(1 << 20, 0), (20, 0), (20, 4)])
def test_suffix_ranks(spark, monkeypatch, local, alphabet):
    monkeypatch.setattr(suffix_array, "LOCAL", local)
    monkeypatch.setattr(suffix_array, "BLOCK", 30)
    rng = np.random.default_rng(local)
    v = np.concatenate([np.tile(rng.integers(1, 4, 25), 3), np.zeros(3, np.int64)])
    text = suffix_array.to_blocks(spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "pos long, value long"), len(v))
    got = dict((r.block, np.frombuffer(r["values"], np.int64)) for r in suffix_array.suffix_ranks(text, len(v), alphabet).collect())
    order = sorted(range(len(v)), key=lambda i: v[i:].tolist())
    want = np.empty(len(v), np.int64)
    want[order] = range(len(v))
    assert (np.concatenate([got[k] for k in sorted(got)]) == want).all()


def test_empty_table(spark):
    assert substrings.digests(cases.frame(spark, ["a"]).limit(0)).count() == 0
    assert [r.n_removed for r in substrings.digests(cases.frame(spark, ["short"])).collect()] == [0]


def common_line(seed):
    """Texts that share a line between words of their own, some with the same neighbours."""
    rng = random.Random(seed)
    line = cases.prose(rng, 40, 5000)
    around = [cases.prose(rng, 12, 50_000) for _ in range(6)]
    return [f"{rng.choice(around)} {i if i % 3 else ''} {line} {rng.choice(around)}" for i in range(40)] + ["-" * 700, "ab\n" * 120, "x" + "-" * 300]


@pytest.mark.parametrize("held", [1, 7, 500])
def test_cuts_between_suffixes_lose_nothing(spark, monkeypatch, held):
    monkeypatch.setattr(suffix_array, "ROWS", held)
    texts = made(3, 12) + common_line(held)
    docs = cases.frame(spark, texts)
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)])
    got = {r[0]: tuple(r[1:]) for r in substrings.digests(docs).collect()}
    assert got == want


def test_windows_are_served_once(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [250, 0, 99, 100, 3, 1000]
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(97, 100, at[-1], dtype=np.uint8)
    served = []
    for piece in (substrings.PIECE, 64):
        monkeypatch.setattr(substrings, "PIECE", piece)
        served.append(sorted((int(t), int(p - d), int(p), int(h)) for t, p, near, far, h in zip(*substrings.windows(data, at))
                             for d in range(near, far + 1)))
    assert served[0] == served[1]
    assert [s[:2] for s in served[0]] == [(t, i) for t, n in enumerate(sizes) for i in range(n - L + 1)]


def test_tables_between_steps_stay_under_twice_the_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "LOCAL", 1000)
    rng = random.Random(8)
    passages = [cases.prose(rng, 200, 50_000) for _ in range(40)]
    texts = [" ".join([cases.prose(rng, 800, 50_000), rng.choice(passages)]) for _ in range(120)]
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = written()
    assert sum(r.n_removed for r in substrings.digests(cases.frame(spark, texts)).collect()) > 50_000
    assert written() - before < 2 * sum(len(t.encode()) for t in texts)
