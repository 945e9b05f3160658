"""Conversation structure repair (13): the cheapest edits that make the roles of a conversation an optional system row and then
pairs of user and assistant, by Hirschberg's divide and conquer.

Rows stand by turn (nulls first), then role, then the MD5 of the text. A row's first fault counts: blank (no sign but white space),
duplicate (role and text seen earlier), truncated (its last such sign is none of .!?). Keep costs 0, Rerole to user or assistant 2, Delete 3
(the only edit of blank and duplicate rows), Insert of an empty row 2; a truncated row that stays adds 1. Of equally cheap audits (initials of
the edits in order) the first in ASCII order is taken.

Four states tell what the roles so far allow: nothing yet, after the system row, after a user, after an assistant. A row, with the inserts before it,
is a 4 x 4 matrix of least costs from state to state, with the order of the audits that reach each state. From the left a vector of four
costs (and the order of their audits) is carried to the middle, from the right another; where their sum is least, and the audit before it first, the
optimal path crosses. Both halves are then solved with that state fixed. Audits that end in different states behind the same row never begin one
with the other, so comparing their first halves is enough.

A conversation is never one task's: rows are numbered in a range-partitioned sort, and blocks of 2^12 numbers become matrices; blocks of a conversation
that has several are joined to matrices of 2^22 numbers, and so on. The crossing states then go down the same levels. Only the digest of
a conversation is made in one task, because SHA-256 reads its bytes in order; rows and texts stream through it. All conversations of a batch take
each step together in numpy.

Cases: a null conv_id is a conversation of its own; null turns come first; null roles and texts are one space; an empty table gives an empty
result; repeated rows are duplicates of the first. A conversation without rows (all lost in the damage) has an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import rows
from recollect.operators.skew import join_lookup
from recollect.session import cut_lineage

BLOCK_BITS = 12
FAN_BITS = 10
ROW_LIMIT = 100_000  # rows that a task takes through numpy at once
NEVER = 1 << 40

BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"  # anything else is 3
ROLE = {2: "user", 3: "assistant"}  # by the state that the row leads to
AFTER_INSERT = (2, 2, 3, 2)
AFTER_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TO_END = np.array([0, 4, 2, 0])  # cost of the inserts behind the last row


# --- matrices of rows --------------------------------------------------------------------------------

def row_matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each initial and each of (sound, truncated, to be deleted): least cost from state to state, the place of the edits among those from
    the same state in ASCII order, and the edits."""
    cost = np.full((12, 4, 4), NEVER)
    edits = np.full((12, 4, 4), "", object)
    for kind in range(12):
        initial, fault = (INITIALS + "?")[kind // 3], kind % 3
        for before in range(4):
            state = before
            for k in range(3):
                options = [("D", state, 3)]
                if fault < 2:
                    options.append(("R", AFTER_INSERT[state], 2 + fault))
                    if (state, initial) in AFTER_KEEP:
                        options.append(("K", AFTER_KEEP[state, initial], fault))
                for edit, to, price in options:
                    found = (2 * k + price, "I" * k + edit)
                    if found < (cost[kind, before, to], edits[kind, before, to] or "~"):
                        cost[kind, before, to], edits[kind, before, to] = found
                state = AFTER_INSERT[state]
    order = np.zeros((12, 4, 4), np.int64)
    for kind in range(12):
        for before in range(4):
            order[kind, before] = [sum(0 < len(o) and o < e for o in edits[kind, before]) for e in edits[kind, before]]
    return cost, order, edits


COST, ORDER, EDITS = row_matrices()


def _step(cost: np.ndarray, order: np.ndarray, by_cost: np.ndarray, by_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One matrix further, for many vectors: least costs of the four states and the order of their audits."""
    through = cost[:, :, None] + by_cost
    via = (through * 8 + order[:, :, None]).argmin(axis=1)
    line, to = np.arange(len(cost))[:, None], np.arange(4)
    least = through[line, via, to]
    place = np.where(least < NEVER, order[line, via] * 8 + by_order[line, via, to], 99)
    return np.minimum(least, NEVER), (place[:, None, :] < place[:, :, None]).sum(axis=2)


def _from(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that are in one state each."""
    return np.where(states[:, None] == np.arange(4), 0, NEVER), np.zeros((len(states), 4), np.int64)


def forward(cost: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost vectors (and order of audits) from `states` over matrices lo..hi, for many stretches at once."""
    vector, place = _from(states)
    by_length = np.argsort(lo - hi, kind="stable")
    lengths = (hi - lo)[by_length]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        some = by_length[:np.searchsorted(-lengths, -t, "left")]
        vector[some], place[some] = _step(vector[some], place[some], cost[lo[some] + t], order[lo[some] + t])
    return vector, place


def backward(cost: np.ndarray, lo: np.ndarray, hi: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Cost vectors to `states` over matrices lo..hi, from the right."""
    vector, _ = _from(states)
    by_length = np.argsort(lo - hi, kind="stable")
    lengths = (hi - lo)[by_length]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        some = by_length[:np.searchsorted(-lengths, -t, "left")]
        vector[some] = np.minimum((cost[hi[some] - 1 - t] + vector[some][:, None, :]).min(axis=2), NEVER)
    return vector


def crossings(cost: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The state behind each matrix on the first of the cheapest paths of every stretch lo..hi from `first` to `last`."""
    out = np.full(len(cost), -1)
    while len(lo):
        out[hi - 1] = last
        some = hi - lo > 1
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        vector, place = forward(cost, order, lo, mid, first)
        both = vector + backward(cost, mid, hi, last)
        cross = (both * 8 + place).argmin(axis=1)
        lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid), (mid, hi), (first, cross), (cross, last)))
    return out


def whole(cost: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of each stretch: its cost vectors from all four states."""
    states = np.tile(np.arange(4), len(lo))
    vector, place = forward(cost, order, np.repeat(lo, 4), np.repeat(hi, 4), states)
    return vector.reshape(-1, 4, 4), place.reshape(-1, 4, 4)


def stretches(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    lo = np.flatnonzero(new)
    return lo, np.append(lo[1:], n)[:len(lo)]


# --- rows --------------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults: by crc32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its .!? (2), is repeated (3)
    or becomes a user's (4)."""
    pick = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    text = _or_space("text")
    return (conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(pick == 4, "user").otherwise(_or_space("role")).alias("role"),
        F.when(pick == 1, "").when(pick == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(pick == 0, 0).when(pick == 3, 2).otherwise(1).alias("_copies"))
        .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).drop("_copy"))


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


KEY = ("conv", "turn", "role", "digest")


def _keyed(conversations: DataFrame) -> DataFrame:
    text = _or_space("text")
    return conversations.select(rows.row_id("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"),
                                F.md5(text.cast("binary")).alias("digest"), text.alias("text"))


def faults(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, digest of every row, its place among all rows (`at`, a long that follows their order) and its fault."""
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    order = [F.col(c).asc_nulls_first() for c in KEY]
    ordered = cut_lineage(_keyed(conversations).select(*KEY, fault.alias("fault")).repartitionByRange(*order)
                          .sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    same = ("conv", "role", "digest")
    first = ordered.where(F.col("fault") != BLANK).groupBy(*same).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = (F.col("at") > F.col("first")) & (F.col("fault") != BLANK)
    return cut_lineage(join_lookup(ordered, first, list(same)).withColumn("fault", F.when(late, DUPLICATE).otherwise(F.col("fault"))).drop("first"))


def _symbols(initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    return initial * 3 + np.array([0, 2, 2, 1])[fault]


INITIAL = "CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END"


def _in_blocks(table: DataFrame, bits: int, run: Callable, schema: str, *order: str) -> DataFrame:
    """`run` over the rows of each block of 2^bits places, sorted; it gets several whole blocks at once as a dictionary of arrays."""
    columns = [*table.columns, "block"]
    keys = ("conv", "block") if "conv" in order else ("block",)

    def batches_of(batches):
        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += len(table)
            if size < ROW_LIMIT:
                continue
            every = pa.concat_tables(held).combine_chunks()
            last = int(stretches(*(every[k].to_numpy() for k in keys))[0][-1])
            if last:
                yield every.slice(0, last)
            held, size = [every.slice(last)], len(every) - last
        if size:
            yield pa.concat_tables(held).combine_chunks()

    def each(batches):
        for part in batches_of(batches):
            yield from run(part)

    blocks = table.withColumn("block", F.shiftright("at", bits))
    blocks = blocks.repartition(*keys).sortWithinPartitions(*keys, *order)
    return blocks.select(*columns).mapInArrow(each, schema)


MATRIX = "conv long, at long, cost array<long>, place array<long>"


def _matrices(conv: np.ndarray, at: np.ndarray, cost: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(conv) + 1) * 16, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(at), *(pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).astype(np.int64))) for x in (cost, place))],
                                      names=["conv", "at", "cost", "place"])


def _stacked(part: pa.Table, column: str) -> np.ndarray:
    return part[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4, 4)


def _numbers(part: pa.Table, *columns: str) -> list[np.ndarray]:
    return [part[c].to_numpy().astype(np.int64) for c in columns]


def _of_rows(part):
    conv, at, initial, fault, block = _numbers(part, "conv", "at", "initial", "fault", "block")
    lo, hi = stretches(conv, block)
    symbol = _symbols(initial, fault)
    yield _matrices(conv[lo], at[lo], *whole(COST[symbol], ORDER[symbol], lo, hi))


def _of_matrices(part):
    conv, at, block = _numbers(part, "conv", "at", "block")
    lo, hi = stretches(conv, block)
    yield _matrices(conv[lo], at[lo], *whole(_stacked(part, "cost"), _stacked(part, "place"), lo, hi))


STATES = "conv long, at long, first long, last long"


def _states(conv, at, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, at, first, last)], names=["conv", "at", "first", "last"])


def _before(out: np.ndarray, lo: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each matrix, from the state behind each."""
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[lo] = first
    return before


def _down(part):
    """Rows of a conversation and block: one (kind 0) with the states at its ends, then its matrices."""
    kind, conv, at = _numbers(part, "kind", "conv", "at")
    head = kind == 0
    first, last = (part[c].to_numpy(zero_copy_only=False)[head].astype(np.int64) for c in ("first", "last"))
    body = part.filter(pa.array(~head))
    lo = np.flatnonzero(head) - np.arange(head.sum())
    hi = np.append(lo[1:], len(body))
    out = crossings(_stacked(body, "cost"), _stacked(body, "place"), lo, hi, first, last)
    yield _states(conv[~head], at[~head], _before(out, lo, first), out)


def _tops(part: DataFrame) -> DataFrame:
    """First and last state of whole conversations, from their matrices."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            conv, at = _numbers(table, "conv", "at")
            last = ((_stacked(table, "cost")[:, 0] + TO_END) * 8 + _stacked(table, "place")[:, 0]).argmin(axis=1) if len(conv) else conv
            yield _states(conv, at, np.zeros(len(conv), np.int64), last)

    return part.mapInArrow(run, STATES)


def block_states(typed: DataFrame) -> DataFrame:
    """The states at both ends of every block of a conversation (`at`: its first row), on the first of the cheapest paths."""
    level = cut_lineage(_in_blocks(typed.select("conv", "at", F.expr(INITIAL).alias("initial"), "fault"), BLOCK_BITS, _of_rows, MATRIX, "at"))
    tops, inner, bits = [], [], BLOCK_BITS
    while True:
        number = level.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
        several = cut_lineage(number.where("n > 1").select("conv"))
        tops.append(_tops(join_lookup(level, several, ["conv"], "left_anti")))
        if several.isEmpty():
            break
        bits = min(bits + FAN_BITS, 63)
        children = cut_lineage(join_lookup(level, several, ["conv"], "left_semi"))
        inner.append((children, bits))
        level = cut_lineage(_in_blocks(children, bits, _of_matrices, MATRIX, "conv", "at"))
    known = cut_lineage(tops.pop())
    for (children, bits), top in zip(reversed(inner), reversed(tops)):
        heads = known.withColumn("kind", F.lit(0))
        both = heads.unionByName(children.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        known = cut_lineage(_in_blocks(both, bits, _down, STATES, "conv", "kind", "at").unionByName(top))
    return known


EDITED = "conv long, turn long, role string, digest string, at long, fault int, edits string"


def edits(typed: DataFrame) -> DataFrame:
    """Every row with the edits up to it: inserts before it, then its own."""
    heads = block_states(typed).withColumn("kind", F.lit(0))
    body = typed.withColumn("initial", F.expr(INITIAL)).withColumn("kind", F.lit(1))

    def run(part):
        kind, conv, block = _numbers(part, "kind", "conv", "block")
        head = kind == 0
        first, last = (part[c].to_numpy(zero_copy_only=False)[head].astype(np.int64) for c in ("first", "last"))
        own = part.filter(pa.array(~head))
        initial, fault = (own[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("initial", "fault"))
        symbol = _symbols(initial, fault)
        lo = np.flatnonzero(head) - np.arange(head.sum())
        out = crossings(COST[symbol], ORDER[symbol], lo, np.append(lo[1:], len(own)), first, last)
        made = EDITS[symbol, _before(out, lo, first), out]
        for batch in own.select(["conv", "turn", "role", "digest", "at", "fault"]).append_column("edits", pa.array(made, pa.string())).to_batches():
            yield batch

    both = body.unionByName(heads, allowMissingColumns=True)
    return _in_blocks(both, BLOCK_BITS, run, EDITED, "at", "kind")


# --- repaired conversations --------------------------------------------------------------------------

class Repair:
    """One conversation, row by row in order: counts, audit, and the repaired rows through `keep(role, text, edit)`."""

    def __init__(self, keep: Callable[[str, str, str], None]):
        self.keep, self.audit, self.cost, self.state = keep, [], 0, 0
        self.faults, self.illegal, self.initial = [0] * 4, 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def row(self, turn, role: str, text: str, fault: int, edits: str):
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.faults[fault] += 1
        self.audit.append(edits)
        for edit in edits:
            if edit == "D":
                self.cost += 3
                continue
            self.cost += (fault == TRUNCATED) * (edit != "I") + 2 * (edit != "K")
            self.state = AFTER_KEEP[self.state, role[:1]] if edit == "K" else AFTER_INSERT[self.state]
            self.keep(role if edit == "K" else ROLE[self.state], "" if edit == "I" else text, edit)

    def end(self):
        while self.state in (1, 2):
            self.state = AFTER_INSERT[self.state]
            self.cost += 2
            self.audit.append("I")
            self.keep(ROLE[self.state], "", "I")

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


DIGESTS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
REPAIRED = "conv_id long, line long, role string, text string, edit string"


class _Digests:
    def __init__(self):
        self.rows = []

    def begin(self, conv):
        self.conv, self.sha, self.any = conv, hashlib.sha256(), False
        return Repair(self.keep)

    def keep(self, role, text, edit):
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def done(self, r: Repair):
        self.rows.append((self.conv, r.gaps(), r.faults[BLANK], r.faults[DUPLICATE], r.faults[TRUNCATED], r.illegal, r.cost, "".join(r.audit),
                          self.sha.hexdigest()))


class _Lines:
    def __init__(self):
        self.rows = []

    def begin(self, conv):
        self.conv, self.line = conv, 0
        return Repair(self.keep)

    def keep(self, role, text, edit):
        self.rows.append((self.conv, self.line, role, text, edit))
        self.line += 1

    def done(self, r: Repair):
        pass


def _streamed(damaged: DataFrame, every: DataFrame, schema: str, make) -> DataFrame:
    """Rows of each conversation in order, the text before the rows that share role and digest, through one collector for each task."""
    keyed = _keyed(damaged)
    texts = keyed.withColumn("kind", F.lit(1))
    actions = edits(faults(damaged)).withColumn("kind", F.lit(2))
    marks = every.select(rows.row_id("conv_id").alias("conv")).distinct().withColumn("kind", F.lit(0))
    both = actions.unionByName(texts, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in (*KEY, "kind", "at")]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        out, repair, conv, text, at = make(), None, None, "", None

        def batch_of():
            columns = list(zip(*out.rows)) or [()] * len(names)
            kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in schema.split(", ")]
            out.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for own, turn, role, digest, kind, of, fault, made in zip(*(batch.column(c).to_pylist() for c in (
                    "conv", "turn", "role", "digest", "kind", "text", "fault", "edits"))):
                if own != conv:
                    if repair:
                        repair.end()
                        out.done(repair)
                    conv, repair = own, out.begin(None if own == rows.NO_ID else own)
                if kind == 1:
                    text = of
                elif kind == 2:
                    repair.row(turn, role, text, fault, made)
                if len(out.rows) >= 1_000:
                    yield batch_of()
        if repair:
            repair.end()
            out.done(repair)
            yield batch_of()

    columns = [*KEY, "kind", "text", "fault", "edits"]
    return both.repartition("conv").sortWithinPartitions(*order).select(*columns).mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, line (from 0), role, text and the edit that they come from (K, R or I)."""
    return _streamed(conversations, conversations, REPAIRED, _Lines)


def digests(conversations: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired rows; of `damaged` rows
    if given, in which a conversation may have lost all."""
    return _streamed(conversations if damaged is None else damaged, conversations, DIGESTS, _Digests)
