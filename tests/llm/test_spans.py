from __future__ import annotations

import random
import re

import cases

from recollect.llm import spans
from recollect.llm.rows import NO_ID


def sentences(text):
    """(start, end) of each sentence, and its words."""
    out, own = [], []
    found = list(re.finditer(cases.BLANK_WORD, text))
    for k, m in enumerate(found):
        own.append(m)
        after = found[k + 1].start() if k + 1 < len(found) else None
        if m[0][-1] in ".!?" or after is None or "\n" in text[m.end():after]:
            out.append((own[0].start(), m.end(), len(own)))
            own = []
    return out


def brute(docs):
    """docs: distinct (key, text), in order of the key."""
    seen, held = {}, []
    for key, text in docs:
        ss = sentences(text)
        for i in range(len(ss)):
            j = i + 3
            while j <= len(ss) and sum(s[2] for s in ss[i:j]) < 15:
                j += 1
            if j <= len(ss):
                what = tuple(text[a:b] for a, b, _ in ss[i:j])
                held.append((what, key, i, j))
                seen.setdefault(what, (key, i))
    gone = {}
    for what, key, i, j in held:
        if seen[what] != (key, i):
            gone.setdefault(key, set()).update(range(i, j))
    out = {}
    for key, text in docs:
        ss, kept, at = sentences(text), [], 0
        for k, (a, _, _) in enumerate(ss):
            if k in gone.get(key, ()):
                kept.append(text[at:a])
                at = ss[k + 1][0] if k + 1 < len(ss) else len(text)
        out[key] = (len(ss), len(gone.get(key, ())), "".join(kept) + text[at:])
    return out


def made(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(cases.prose(rng, rng.randrange(1, 9), 3000).replace("\n", "") + rng.choice([".", "!", "?\n", ". "]) for _ in range(n))
    passages = [say(rng.randrange(3, 9)) for _ in range(6)]
    texts = [*cases.ODD, "le. " * 40, "le.\nle.\n" * 20]
    for _ in range(120):
        bits = [say(rng.randrange(0, 6)), rng.choice(passages), say(rng.randrange(0, 4)), rng.choice([*passages, ""])]
        texts.append(rng.choice([" ", "\n", "  \n "]).join(bits))
    return texts + rng.sample(texts, 20)


def test_kept_texts_equal_brute_force(spark):
    docs = cases.frame(spark, made(), extra=True)
    rows = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) tag").collect()
    keys = sorted({((NO_ID if r.doc_id is None else r.doc_id, r.tag), r.text) for r in rows})
    want = brute(keys)
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.kept_text) for r in spans.removed(docs).collect())
    assert got == sorted((str(r.doc_id), *want[(NO_ID if r.doc_id is None else r.doc_id, r.tag)]) for r in rows)
    assert sum(w[1] for w in want.values()) > 200


def wide_spans(ss):
    """(first, last) of the spans of the wide rule, by trying all."""
    out, size = set(), lambda i, j: sum(s[2] for s in ss[i:j])
    fits = lambda i, j: j - i >= 2 and size(i, j) >= 15
    for i in range(len(ss)):
        out.update([(i, j) for j in range(i, len(ss) + 1) if fits(i, j)][:1])
        out.update([(j, i + 1) for j in range(i, -1, -1) if fits(j, i + 1)][:1])
        if ss[i][2] > 50 or len(ss) == 1 and ss[i][2] >= 15:
            out.add((i, i + 1))
    return out


def brute_wide(docs):
    """docs: distinct (key, text), in order of the key."""
    seen, held = {}, []
    for key, text in docs:
        ss = sentences(text)
        for i, j in sorted(wide_spans(ss)):
            what = tuple(text[a:b] for a, b, _ in ss[i:j])
            held.append((what, key, i, j))
            seen.setdefault(what, (key, i))
    gone = {}
    for what, key, i, j in held:
        if seen[what] != (key, i):
            gone.setdefault(key, set()).update(range(i, j))
    out = {}
    for key, text in docs:
        ss = sentences(text)
        ends = [a for a, _, _ in ss[1:]] + [len(text)]
        kept = "".join(text[a:e] for k, ((a, _, _), e) in enumerate(zip(ss, ends)) if k not in gone.get(key, ()))
        out[key] = (len(ss), len(gone.get(key, ())), (text[:ss[0][0]] if ss else text) + kept)
    return out


def test_wide_rule_equals_brute_force(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(rng.choices("abcdefghij", k=n)) + "."
    shared = [" ".join(plain(n) for n in sizes) for sizes in ((60,), (9, 8), (30, 2, 2), (2, 2, 30), (7, 1, 7), (16,), (51,), (50,))]
    texts = made(2) + [f"{plain(4)} {p} {plain(3)}" for p in shared * 2] + shared * 2 + ["x " * 400]
    docs = cases.frame(spark, texts, extra=True)
    rows = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) tag").collect()
    want = brute_wide(sorted({((NO_ID if r.doc_id is None else r.doc_id, r.tag), r.text) for r in rows}))
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.kept_text) for r in spans.removed(docs, wide=True).collect())
    assert got == sorted((str(r.doc_id), *want[(NO_ID if r.doc_id is None else r.doc_id, r.tag)]) for r in rows)


def test_passages_of_few_sentences_go(spark):
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n)) + "."
    two, long = f"{say('a', 30)} {say('b', 40)}", say("c", 51)
    tail = f"{say('d', 30)} {say('e', 2)} {say('f', 2)}"
    copies = [say("g", 20), say("h", 2320), two, tail]
    texts = [f"{say('p', 9)} {two} {say('q', 9)}", f"{say('r', 9)} {two} {say('s', 9)}",
             f"{say('t', 9)} {long} {say('u', 9)}", f"{say('v', 9)} {long} {say('w', 9)}", *copies, *copies, say("k", 14), say("k", 14)]
    got = {r.doc_id: r.n_removed for r in spans.digests(cases.frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 2, 0, 1, 0, 0, 2, 0, 1, 1, 2, 3, 0, 0]


def test_empty_table(spark):
    assert spans.digests(cases.frame(spark, ["a"]).limit(0)).count() == 0
