from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from recollect.llm import alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["Hello, wörld's  naïve  café.\n\nTabs\tand 12345 numbers", "a<|endoftext|>b <s> </s> <unk> <0x41>", "▁ is a piece sign", "日本語のテキスト 🙂🙂",
         "don't we'll I'M 'S  x", "\x00\x01 \x85\xa0", "The same text.", "The same text.", "é   end", " lead", "trail ", "\n", "　　a"]


def brute(texts):
    """Links and groups token by token, straight from the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.paths()
    lib_a = Tokenizer.from_file(a_path)
    lib_a.encode_special_tokens = True
    lib_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    of_sign = alignment.byte_of_sign()
    found, docs_of = [], Counter()
    for text in texts:
        a = lib_a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = lib_b.encode(text or "")
        bytes_a = [bytes(of_sign[c] for c in lib_a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue
        links, at = [], 0
        spans_b, end = [], 0
        for t in bytes_b:
            spans_b.append((end, end + len(t)))
            end += len(t)
        ends_a = []
        for i, t in zip(a, bytes_a):
            links += [(i, j) for j, (lo, hi) in zip(b, spans_b) if lo < at + len(t) and at < hi]
            at += len(t)
            ends_a.append(at)
        common = sorted(set(ends_a) & {hi for _, hi in spans_b})
        groups = defaultdict(lambda: ([], []))
        for side, ids, ends in ((0, a, ends_a), (1, b, [hi for _, hi in spans_b])):
            for i, hi in zip(ids, ends):
                groups[next(c for c in common if c >= hi)][side].append(i)
        shown = ";".join(f"{','.join(map(str, groups[c][0]))}|{','.join(map(str, groups[c][1]))}" for c in common)
        found.append((len(a), len(b), len(common), links, shown))
        docs_of.update(set(links))
    best = Counter()
    for (a, _), n in docs_of.items():
        best[a] = max(best[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n = [docs_of[x] for x in f[3]]
        out.append((*f[:3], len(f[3]), sum(docs_of[x] == best[x[0]] for x in f[3]), sum(n), hashlib.sha256(f[4].encode()).hexdigest()))
    return out, docs_of


def rows_of(df):
    return Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("block_pairs", [alignment.BLOCK_PAIRS, 40])
def test_equals_token_by_token(spark, monkeypatch, block_pairs):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)
    monkeypatch.setattr(alignment, "FAN", 2)
    import random

    rng = random.Random(5)
    texts = cases.ODD + TEXTS + [cases.prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    docs = cases.frame(spark, texts, extra=True)
    got = alignment.align(docs, block_pairs=block_pairs)
    assert got.columns == ["doc_id", *COLUMNS]
    every = [(r.doc_id, r.text) for r in docs.collect()]
    expected, _ = brute([t for _, t in every])
    assert rows_of(got) == Counter((i, *e) for (i, _), e in zip(every, expected))


def test_pair_counts_and_groups(spark):
    texts = TEXTS + [None, ""]
    docs = cases.frame(spark, texts)
    _, docs_of = brute(texts)
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(docs).collect()} == dict(docs_of)
    for r in alignment.align(docs, with_groups=True).collect():
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
        assert r.n_groups == (r.groups.count("|") if r.groups else 0)


def test_long_texts(spark):
    texts = ["word, " * 400_000, "a" * 300_000, " " * 300_000, "!" * 50_000 + "é" * 50_000, "1 " * 10]
    got = {r.doc_id: r for r in alignment.align(cases.frame(spark, texts)).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(alignment.paths()[0])
    for k, text in enumerate(texts):
        assert got[k].n_a == len(library.encode(" " + text, add_special_tokens=False).ids)
        assert got[k].n_links >= max(got[k].n_a, got[k].n_b)


def test_empty(spark):
    for texts in ([], [None, ""]):
        got = alignment.align(cases.frame(spark, texts)).collect()
        assert [r.n_links for r in got] == [0] * len(texts)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 47, 50_000))
    sizes, bits, placed = alignment.perfect_hash(keys)
    assert np.array_equal(np.sort(placed), keys) and bits.sum() == len(keys)
    assert sum(sizes) < 6 * len(keys)
    shards = alignment.shard_of(keys)
    parts = [(s, *alignment.perfect_hash(keys[shards == s])) for s in np.unique(shards)]
    index = alignment.Index([p[1] for p in parts], np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), [p[0] for p in parts])
    assert np.array_equal(np.sort(index.find(keys)), np.arange(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 47, 5_000), keys)
    assert (index.find(other) == -1).all()
