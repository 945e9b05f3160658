from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from recollect.llm import conversations

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        pick = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if pick == 0:
            continue
        if pick == 1:
            text = ""
        if pick == 2:
            text = re.sub("[.!?]", "", text)
        if pick == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if pick == 3 else 1)
    return out


def plain(rows):
    """Row by row, every state with its cheapest and then least audit."""
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    for conv, own in groups.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, _, text in own:
            stripped = text.rstrip(" \t\n\x0b\x0c\r")
            if not stripped:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
        # states: "" nothing, "s", "u", "a"; each with (cost, audit, repaired rows)
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, "", ())}

        def inserted(states):
            states = dict(states)
            for _ in range(3):
                for state, (cost, audit, made) in list(states.items()):
                    to = follow[state]
                    new = (cost + 2, audit + "I", (*made, ("user" if to == "u" else "assistant", "")))
                    if to not in states or new[:2] < states[to][:2]:
                        states[to] = new
            return states

        for (_, _, role, _, text), fault in zip(own, faults):
            new = {}

            def offer(state, *found):
                if state not in new or found[:2] < new[state][:2]:
                    new[state] = found

            for state, (cost, audit, made) in inserted(best).items():
                offer(state, cost + 3, audit + "D", made)
                if fault in ("blank", "duplicate"):
                    continue
                late = fault == "truncated"
                to = follow[state]
                offer(to, cost + 2 + late, audit + "R", (*made, ("user" if to == "u" else "assistant", text)))
                if role[:1] == to or role[:1] == "s" and state == "":
                    offer(role[:1], cost + late, audit + "K", (*made, (role, text)))
            best = new
        cost, audit, made = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
        turns = [t for there, t, *_ in own if there]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, made)
    return out


def digest(made):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def random_rows(rng, n_convs, most):
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "sys"])
            text = rng.choice(["Same.", "One two.", "no end", "", " \n", None, "Ünï 🙂!", f"Word {rng.random()}.", f"cut {rng.random()}"])
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 9 == 0 else conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows


def expected(rows, hurt):
    every = {conv: (0, 0, 0, 0, 0, 0, "", ()) for conv, *_ in rows} | plain(damaged(rows) if hurt else [
        (c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    return every


@pytest.mark.parametrize(("bits", "fan"), [(12, 10), (2, 1), (1, 2)])
def test_equals_row_by_row(spark, monkeypatch, bits, fan):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    monkeypatch.setattr(conversations, "FAN_BITS", fan if bits == 12 else 6)
    monkeypatch.setattr(conversations, "ROW_LIMIT", 7 if bits < 12 else 100_000)
    rows = random_rows(random.Random(bits), 60, 12) + random_rows(random.Random(7), 1, 150)
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("at", "kind", "block", "conv", "digest", "fault", "_copies"):
        df = df.withColumn(name, df.role)
    got = conversations.digests(df, conversations.damage(df))
    assert got.columns == ["conv_id", *COLUMNS]
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert found == {c: (*v[:-1], digest(v[-1])) for c, v in expected(rows, True).items()}


def test_repaired_rows(spark):
    rows = random_rows(random.Random(3), 30, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    made = defaultdict(list)
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: (str(r.conv_id), r.line)):
        made[r.conv_id].append((r.role, r.text))
        assert r.edit in "KRI"
    for conv, want in expected(rows, False).items():
        assert tuple(made[conv]) == want[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made[conv]))


def test_one_long_conversation(spark, monkeypatch):
    """A conversation of many blocks, among them a great many equal rows and a very long text."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", 6)
    monkeypatch.setattr(conversations, "FAN_BITS", 3)
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Row {t}.") for t in range(3_000)] + [(1, 5_000, "user", "again.")] * 2_000
    rows += [(1, 6_000, "assistant", "long " * 1_000_000 + "."), (2, 0, "user", "x.")]
    got = {r.conv_id: r for r in conversations.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = expected(rows, False)
    assert {c: tuple(r[k] for k in COLUMNS) for c, r in got.items()} == {c: (*v[:-1], digest(v[-1])) for c, v in want.items()}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.digests(df, conversations.damage(df)).count() == 0
    assert conversations.repaired(df).count() == 0
