"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import clean_space, valid_name, valid_role
from recollect.operators.metadata import too_deep
from recollect.settings import SHARED_WORKSPACE, TIMELESS_IMPORTANCE

SIDECARS = ("_conclusions", "_reasoning", "_codeedges")


def all_of(conditions: list[Column]) -> Column:
    """A13."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals(**values) -> Column:
    """B1: equality on every given column; empty values give no predicate."""
    return all_of([F.col(k) == F.lit(v) for k, v in values.items() if v not in (None, "")])


def visible(workspace: str = "", session: str = "", role: str = "", scope: str = "",
            peer: str = "", excluded: tuple[str, ...] = (), shared: str = SHARED_WORKSPACE) -> Column:
    """The rows a search may see. A named workspace also sees the shared one,
    where the session does not count; an unnamed one sees all that are not excluded."""
    rest = equals(role=role, scope=scope, peer_id=peer)
    own = equals(workspace_id=workspace, session_id=session)
    if not workspace:
        return not_excluded(F.col("workspace_id"), excluded) & equals(session_id=session) & rest
    if workspace == shared:
        return equals(workspace_id=shared) & rest
    return (own | (F.col("workspace_id") == shared)) & rest


def not_excluded(workspace: Column, excluded: tuple[str, ...]) -> Column:
    """B11."""
    return ~F.lower(clean_space(workspace)).isin(*excluded) if excluded else F.lit(True)


def differs(column: Column, value: str) -> Column:
    """Not equal, keeping rows without a value."""
    return ~column.eqNullSafe(F.lit(value))


def is_edge(id_: Column, chunk_type: Column) -> Column:
    """B4."""
    return (id_.startswith("codeedge_") | id_.startswith("edge_")
            | (F.coalesce(chunk_type, F.lit("")) == "edge"))


def role_or_unknown(role: str) -> Column:
    """B5."""
    return (F.col("role").isNull() | (F.col("role") == role)) if role else F.lit(True)


def within(ts: Column, after: str | None = None, before: str | None = None) -> Column:
    """Inclusive bounds; rows without a time go only when a bound is set."""
    bounds = []
    if after:
        bounds.append(ts >= F.to_timestamp(F.lit(after)))
    if before:
        bounds.append(ts <= F.to_timestamp(F.lit(before)))
    return F.coalesce(all_of(bounds), F.lit(False)) if bounds else F.lit(True)


def contains_text(document: Column, needle: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(document), F.lower(F.lit(needle)))


def timeless(role: Column, importance: Column) -> Column:
    """B13."""
    return F.coalesce(role == "system", F.lit(False)) | F.coalesce(
        importance >= TIMELESS_IMPORTANCE, F.lit(False))


def subscribed(events: Column, event: str) -> Column:
    """An empty list means every event."""
    return (F.coalesce(F.size(events), F.lit(0)) <= 0) | F.array_contains(events, event)


def validate_messages(rows: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds an `error`, null where the row is fine; every row comes back. The checks are made
    in the order in which the first failing one is reported. `max_bytes` bounds a message at the edge of a
    service; tables of messages have no such bound."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    meta = F.coalesce(F.size("metadata"), F.lit(0))
    too_large = (F.octet_length("content") > max_bytes) if max_bytes else F.lit(False)
    return rows.withColumn(
        "error",
        F.when(~(given("session_id") & given("role") & given("content")), "session_id, role and content are required")
        .when(~valid_role(F.col("role")), "role must be 'user', 'assistant', or 'system'")
        .when(too_large, "content too large")
        .when(~given("workspace_id"), "workspace_id is required")
        .when(~valid_name(F.col("workspace_id")) | ~valid_name(F.col("session_id")),
              "invalid id format")
        .when(meta > 100, "invalid metadata: metadata exceeds 100 keys")
        .when(too_deep(F.col("metadata")), "invalid metadata: metadata depth >5"))


def workspaces_of(collections: DataFrame) -> DataFrame:
    """Collection names that are workspaces: `ws_` names without the ones that only
    accompany an existing parent. `collections` has a column `name`."""
    suffix = F.regexp_extract("name", f"({'|'.join(SIDECARS)})$", 1)
    named = collections.where(F.col("name").startswith("ws_")).select(
        "name", F.when(suffix != "", F.left("name", F.char_length("name") - F.char_length(suffix)))
        .alias("parent"))
    parents = collections.select(F.col("name").alias("parent")).distinct()
    orphans = named.where(F.col("parent") == "ws_")
    sidecars = named.join(parents, "parent", "left_semi").select("name").unionByName(
        orphans.select("name"))
    return named.join(sidecars, "name", "left_anti").select(
        F.regexp_replace("name", "^ws_", "").alias("workspace_id"))
