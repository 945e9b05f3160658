"""Side effects: session files and webhooks."""

from __future__ import annotations

import ipaddress
import json
import socket
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import session_file_name, vault_owner_dir
from recollect.operators.dml import MESSAGE
from recollect.operators.predicates import subscribed
from recollect.operators.skew import first_seen


def allowed(workspace: Column, names: str) -> Column:
    """A comma-separated list of workspaces; empty allows all."""
    listed = [n.strip() for n in names.split(",") if n.strip()]
    return workspace.isin(*listed) if listed else F.lit(True)


def turn_blocks(messages: DataFrame, owners: tuple[str, ...] = ()) -> DataFrame:
    """Each turn as the Markdown block its session file holds; a message counts once in its workspace."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    marker = F.concat(F.lit("<!-- turn:"), "message_id", F.lit(" -->"))
    file = F.concat_ws("/", vault_owner_dir(F.col("workspace_id"), owners),
                       F.lit("vault/10-memory/sessions"),
                       F.concat(session_file_name(F.col("session_id")), F.lit(".md")))
    head = F.concat(
        F.lit("---\nsource_type: memory\nworkspace: "), "workspace_id", F.lit("\nsession_id: "), "session_id",
        F.lit("\nstatus: staging\ncreated_at: "), at, F.lit("\n---\n\n# Session "), "session_id", F.lit("\n\n"))
    block = F.concat(F.lit("## "), at, F.lit(" · "), "role", F.lit(" · "), "message_id", F.lit("\n\n"),
                     "content", F.lit("\n\n"), marker, F.lit("\n\n"))
    once = first_seen(messages.select(*MESSAGE, "session_id", "role", "content", "created_at"), MESSAGE, [F.col("created_at"), F.col("content")])
    return once.select(
        file.alias("file"), "created_at", "message_id", head.alias("head"), block.alias("block"),
        marker.alias("marker"))


def write_session_files(blocks: DataFrame, root: str) -> None:
    """Appends the blocks to their files below `root`, a folder that all executors mount. One
    task writes a file, in time order and block by block; turns whose marker is in the file
    already are skipped, so a repeated task changes nothing."""
    def append(rows) -> None:
        current, done, out = None, set(), None
        try:
            for row in rows:
                if row.file != current:
                    if out:
                        out.close()
                    path = Path(root, row.file)
                    path.parent.mkdir(parents=True, exist_ok=True)
                    fresh = not path.exists() or path.stat().st_size == 0
                    done = set()
                    if not fresh:
                        with path.open() as stored:
                            done = {line.strip() for line in stored if line.startswith("<!-- turn:")}
                    out, current = path.open("a"), row.file
                    if fresh:
                        out.write(row.head)
                if row.marker not in done:
                    out.write(row.block)
        finally:
            if out:
                out.close()

    blocks.repartition("file").sortWithinPartitions("file", "created_at", "message_id").foreachPartition(append)


def check_endpoint(url: str, resolve: Callable[[str], list[str]] | None = None) -> None:
    """Only public http(s) hosts may be called."""
    parts = urlsplit(url)
    if not parts.hostname:
        raise ValueError("invalid webhook URL")
    if parts.scheme not in ("http", "https"):
        raise ValueError("webhook URL must be http(s)")
    resolve = resolve or (lambda host: [a[4][0] for a in socket.getaddrinfo(host, None)])
    try:
        found = resolve(parts.hostname)
    except OSError:
        found = []
    if not found:
        raise ValueError("webhook host does not resolve")
    if not all(ipaddress.ip_address(a).is_global and not ipaddress.ip_address(a).is_multicast for a in found):
        raise ValueError("webhook target must be a public address")


def deliveries(endpoints: DataFrame, events: DataFrame) -> DataFrame:
    """(url, payload) for every subscribed endpoint of the event's workspace. `events` are
    (workspace_id, event, data)."""
    called = endpoints.join(events, "workspace_id").where(
        (F.coalesce(F.size("events"), F.lit(0)) <= 0) | F.expr("array_contains(events, event)"))
    return called.select("url", F.to_json(F.struct("event", "workspace_id", "data")).alias("payload"))


def subscribers(endpoints: DataFrame, event: str) -> DataFrame:
    return endpoints.where(subscribed(F.col("events"), event))


def deliver(calls: DataFrame, post: Callable[[str, dict], object], inflight: int = 16) -> None:
    """At most `inflight` calls at a time, one per task; a failing endpoint stops none of
    the others."""
    def send(rows) -> None:
        for row in rows:
            try:
                post(row.url, json.loads(row.payload))
            except (OSError, RuntimeError, ValueError):
                continue

    calls.repartition(inflight).foreachPartition(send)
