from __future__ import annotations

import hashlib
import random
import zlib

import cases
import numpy as np
import pytest

from recollect.llm import pieces, token_file
from recollect.llm.rows import NO_ID

BITS = ["a", "B", "The", " ", "  ", "\n", "'s", "é", "ing", "tion", ".", ",", "ü", "🙂", "\t", "0", "12", "İ", "ΑΣ", "ß", "\x00", "\x1c", "\xa0",
        "<|endoftext|>", "<|", "...", "don't", "́", "▁", "<s>", "Word. ", "x" * 70]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(n)] + ["a" * 3000, " " * 500, "ab " * 2000]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 9, 1000, 10_001):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_file.pack(x)
        assert (token_file.unpack(control, data, n) == x).all() and len(control) == -(-n // 4)
        assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in x)


def test_words_are_encoded_as_the_library_does():
    with open(token_file.tokenizer_path(), "rb") as f:
        encoder = token_file.Encoder(f.read())
    all_texts = texts(2, 3000)
    ids, at = encoder.encode(all_texts)
    for t, a, b in zip(all_texts, at, at[1:]):
        assert ids[a:b].tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, 2]


def test_pieces_are_encoded_as_the_library_does():
    with open(pieces.model_path(), "rb") as f:
        encoder = pieces.Encoder(f.read())
    library = encoder.vocabulary.library
    all_texts = texts(3, 3000)
    got = encoder.encode(all_texts)
    for t, own, back in zip(all_texts, got, encoder.decode(got)):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert own.tolist() == want and back == library.decode(want)
    # both forms of the agenda agree
    v = encoder.vocabulary
    for unit in ["▁withhehaaning", "▁▁▁the", "aaaaaaa", "▁É🙂x"]:
        assert v._heap(unit).tolist() == v.encode([unit])[0].tolist()


@pytest.mark.parametrize("block_ids", [1 << 20, 50])
def test_token_file(spark, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(token_file, "BLOCK_IDS", block_ids)
    docs = cases.frame(spark, [*cases.ODD, *texts(5, 60)], extra=True)
    path = token_file.write(docs, str(tmp_path / "tokens"))
    got = token_file.read(spark, path).orderBy("start", "doc_id").collect()
    with open(token_file.tokenizer_path(), "rb") as f:
        library = token_file.Encoder(f.read()).library
    tags = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) tag").collect()
    want, start = [], 0
    for r in sorted(tags, key=lambda r: (NO_ID if r.doc_id is None else r.doc_id, r.tag)):
        raw = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((r.doc_id, start, len(raw) // 4, zlib.crc32(raw), raw))
        start += len(raw) // 4
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == want
    ranks = [r.id for r in spark.read.parquet(path + "/ranks").orderBy("rank").collect()]
    counts = np.bincount(np.concatenate([np.frombuffer(w[4], "<u4") for w in want]), minlength=len(ranks))
    assert ranks == sorted(range(len(ranks)), key=lambda i: (-counts[i], i))


def test_digests_of_pieces(spark):
    docs = cases.frame(spark, [*cases.ODD, *texts(6, 40)], extra=True)
    with open(pieces.model_path(), "rb") as f:
        library = pieces.Encoder(f.read()).vocabulary.library
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in pieces.digests(docs).collect()) == sorted(want)
    told = pieces.encoded(docs).collect()
    assert {str(r.doc_id): r.decoded for r in told if r.doc_id == 4} == {"4": "one"}


def test_empty_tables(spark, tmp_path):
    docs = cases.frame(spark, ["a"]).limit(0)
    assert pieces.digests(docs).count() == 0 and pieces.encoded(docs).count() == 0
    assert token_file.read(spark, token_file.write(docs, str(tmp_path / "none"))).count() == 0
