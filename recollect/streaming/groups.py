"""Groups of a few rows of a key that do not depend on how a stream is cut into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAITING = "message_id STRING, peer_id STRING, content STRING"
GROUPED = "workspace_id STRING, group BIGINT, place BIGINT, message_id STRING, peer_id STRING, content STRING"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["message_id", "peer_id", "content"]


class Gather(StatefulProcessor):
    """Holds fewer than `size` messages of a workspace as list state. A full group leaves at once; a timer
    lets the rest leave `wait` seconds after the first of them came. Groups are numbered for each
    workspace, and the number is state too."""

    def __init__(self, size: int, wait: float | None):
        self.size = size
        self.holds = wait is None or wait > 0
        self.wait_ms = int(wait * 1000) if wait else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.numbered = handle.getValueState("numbered", "n BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        was_held = len(held)
        new = pd.concat(list(rows)).sort_values(["created_at", "message_id"], kind="stable")
        held += [tuple(None if pd.isna(x) else x for x in row) for row in new[FIELDS].itertuples(index=False)]
        full = len(held) - len(held) % self.size if self.holds else len(held)
        if full:
            yield self._leave(key, held[:full])
        rest = held[full:]
        if rest:
            self.waiting.put(rest)
        elif was_held:
            self.waiting.clear()
        if self.wait_ms and (full or not was_held):
            self._wake(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms if rest else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if held:
            self.waiting.clear()
            yield self._leave(key, held)

    def _wake(self, at: int | None) -> None:
        """The one timer of a workspace."""
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if at is not None:
            self.handle.registerTimer(at)

    def _leave(self, key, messages: list[tuple]) -> pd.DataFrame:
        first = self.numbered.get()[0] if self.numbered.exists() else 0
        out = pd.DataFrame(messages, columns=FIELDS)
        out.insert(0, "place", range(len(messages)))
        out.insert(0, "group", first + out["place"] // self.size)
        out.insert(0, "workspace_id", key[0])
        self.numbered.update((first + -(-len(messages) // self.size),))
        return out


def in_groups(messages: DataFrame, size: int = 5, wait: float | None = 2.0) -> DataFrame:
    """A stream of messages (message_id, workspace_id, peer_id, content, created_at) with `group` and `place`.

    Messages of a workspace are taken in the order of their batches and inside one by time, then id; every
    `size` of them are a group, so a stream read in one batch or in a hundred has the same groups. Without a
    `wait` (None) the rest stays in the state until a group is full; with a wait of zero nothing is held from batch to batch. A wait needs a
    trigger that goes on (timers keep asking for batches, so a run with `availableNow` would not end). A task sorts what one batch has of one workspace, which the bound on files of
    a trigger bounds; what it keeps between batches is less than one group. After a restart Spark looks at timers from its first batch
    on, i.e. with the first new message of any workspace; until then the rest is kept, not lost. Repeated rows count each time they come. Messages without a workspace are
    those of a workspace of their own, without a name. The session is set to the RocksDB state store, which lists and timers need.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wanted = messages.select("workspace_id", "message_id", "peer_id", "content", "created_at")
    return wanted.groupBy("workspace_id").transformWithStateInPandas(
        Gather(size, wait), outputStructType=GROUPED, outputMode="append",
        timeMode="ProcessingTime" if wait else "None")
