"""The facade: one method per route of the service, each a DataFrame or a small dict.

Reads are lazy plans over the tables; writes go through `Tables`. An optional workspace claim
restricts every call to one workspace.
"""

from __future__ import annotations

import json
import secrets
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema
from recollect.functions import text as tx
from recollect.functions.markdown import spliced
from recollect.operators import (codegraph, context, dml, graph, knn, metadata, pending, predicates, provenance,
                                 stale, stats, usage)
from recollect.operators.skew import first_seen, page
from recollect.plans import brief as overview
from recollect.plans import search
from recollect.session import cut_and_count, cut_lineage
from recollect.settings import (CONTEXT_TOKENS, MAX_CODE_FILE_BYTES, MAX_CONTENT_BYTES, MAX_QUERY_BYTES, SHARED_WORKSPACE,
                                TRACE_DEPTH, USAGE_RETENTION_DAYS, Settings)
from recollect.sources import files, sinks, vault
from recollect.sources.brain import Brain, ExtractiveBrain, reorder, tagged
from recollect.sources.embedding import Embedder, HashingEmbedder, embed_rows
from recollect.sources.tables import Tables
from recollect.sources.text_index import TextIndex
from recollect.sources.vector_index import VectorIndex
from recollect.streaming import feeds

# How far each reasoning level of a chat goes.
CHAT_LEVELS = {"none": (0, 1, 0.1), "low": (2, 5, 0.3), "medium": (4, 10, 0.5), "high": (6, 15, 0.7),
               "max": (8, 20, 0.9)}
CHAT_CONTEXT_BYTES = 12_000
DREAM_TOKENS, DREAM_MIN_MESSAGES, DREAM_NEAREST = 8000, 3, 0.15


class NotFound(LookupError):
    """Nothing relevant is stored."""


class Memory:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None,
                 brain: Brain | None = None, settings: Settings | None = None, buckets: int = 16,
                 only_workspace: str | None = None, clock=None, auto_tag: bool = False, index_texts: bool = False):
        self.spark = spark
        self.settings = settings or Settings.from_env()
        self.tables = Tables(spark, root, buckets)
        self.embedder = embedder or HashingEmbedder(self.settings.embed_dimensions)
        self.brain = brain or ExtractiveBrain()
        self.only = only_workspace
        self.auto_tag = auto_tag
        self.texts = TextIndex(self.tables) if index_texts else None
        self._clock = clock or (lambda: datetime.now(timezone.utc))

    # -- helpers -----------------------------------------------------------------------------
    def now(self) -> Column:
        return F.timestamp_micros(F.lit(int(self._clock().timestamp() * 1_000_000)))

    def workspace_id(self, name: str) -> str:
        """H6 for a single name; the shared workspace keeps its own."""
        if name == SHARED_WORKSPACE:
            return name
        row = self.spark.range(1).select(tx.resolve_workspace(F.lit(name)).alias("w")).first()
        return row["w"]

    @staticmethod
    def _resolved(column: str) -> Column:
        """H6 for a column; the shared workspace and no workspace stay as they are."""
        named = (F.coalesce(column, F.lit("")) != "") & (F.col(column) != SHARED_WORKSPACE)
        return F.when(named, tx.resolve_workspace(F.col(column))).otherwise(F.col(column)).alias(column)

    def _own(self, workspace: str) -> str:
        workspace = self.workspace_id(workspace) if workspace else ""
        if self.only and workspace != self.only:
            raise PermissionError("workspace mismatch")
        return workspace

    def _rows(self, name: str) -> DataFrame:
        """A table as this caller may see it."""
        rows = self.tables.read(name)
        if self.only and "workspace_id" in rows.columns:
            rows = rows.where(F.col("workspace_id").isin(self.only, SHARED_WORKSPACE))
        return rows

    def _one(self, columns: dict, table: str) -> DataFrame:
        """One new row in a table's columns."""
        wanted = self.tables.schema(table)
        return self.spark.range(1).select(*[
            (columns.get(f.name) if isinstance(columns.get(f.name), Column) else F.lit(columns.get(f.name)))
            .cast(f.dataType).alias(f.name) for f in wanted.fields])

    @staticmethod
    def _texts(items: list[str] | None) -> Column:
        return F.array(*[F.lit(i) for i in items or []]).cast("array<string>")

    # -- the chunk table and its text index --------------------------------------------------
    def _put(self, chunks: DataFrame) -> None:
        """Chunks that are a written table."""
        self.tables.merge("chunks", chunks)
        if self.texts:
            self.texts.add(chunks)

    def _drop(self, keys: DataFrame) -> None:
        """Chunks by workspace, id and message."""
        keys = cut_lineage(keys.select("id", *dml.MESSAGE))
        self.tables.delete("chunks", keys)
        if self.texts:
            self.texts.remove(keys)

    def _drop_where(self, gone: Column) -> None:
        self.tables.delete_where("chunks", gone)
        if self.texts:
            self.texts.prune(self.tables.read("chunks"))

    def reindex_texts(self) -> None:
        """The text index of all chunks as they are stored, for a store that was filled without it."""
        self.texts = self.texts or TextIndex(self.tables)
        self.texts.sync(self.tables.read("chunks").select("workspace_id", "id", "document"))
        self.texts.compact()

    def index_vectors(self) -> VectorIndex:
        """A1: the inverted file of the chunks' vectors: built at first, then brought up to date."""
        path = self.tables.path("vector_index")
        rows = search.content_rows(self.tables.read("chunks")).select("id", "embedding", *search.METADATA, "scope", "peer_id", "peer_ids")
        if not self.tables.exists("vector_index/probes"):
            return VectorIndex.build(rows, path)
        index = VectorIndex(self.spark, path)
        index.refresh(rows)
        return index

    def _query(self, text: str) -> search.Query:
        if not text:
            raise ValueError("query is required")
        if len(text.encode()) > MAX_QUERY_BYTES:
            raise ValueError("query too long")
        return search.Query(text, self.embedder.embed_one(text))

    # -- messages ----------------------------------------------------------------------------
    def add_batch(self, messages: DataFrame, max_bytes: int | None = None) -> DataFrame:
        """L2: stores messages (columns of `schema.MESSAGES_IN`, `message_id` and `created_at`
        optional); returns a receipt for each message: its id, whether it was stored, the error. With
        `max_bytes` larger messages are refused."""
        wanted = [c.split()[0] for c in schema.MESSAGES_IN.replace("\n", " ").split(", ") if c.strip()]
        none = {"metadata": "map<string,string>", "created_at": "timestamp"}
        rows = messages.select(*[
            F.col(c) if c in messages.columns else F.lit(None).cast(none.get(c, "string")).alias(c)
            for c in wanted])
        rows = rows.withColumns({
            # the id follows from what is said, so that a repeated write is the same write
            "message_id": F.coalesce("message_id", F.concat(F.lit("msg_"), F.left(F.sha2(F.concat_ws(
                "|", "workspace_id", "session_id", "role", "content"), 256), F.lit(24)))),
            "created_at": F.coalesce("created_at", self.now()),
            "workspace_id": self._resolved("workspace_id")})
        checked = cut_lineage(predicates.validate_messages(rows, max_bytes))
        if self.only:
            other = F.col("error").isNull() & (F.col("workspace_id") != self.only)
            checked = checked.withColumn("error", F.when(other, "workspace mismatch").otherwise(F.col("error")))
        # a message sent twice in one batch is one message, the later one if they differ
        sent = cut_lineage(first_seen(checked.where("error IS NULL").drop("error"), dml.MESSAGE,
                                      [-F.unix_micros("created_at"), F.col("content")]).select(*wanted))
        # one message per content: repeats inside the batch, then ones stored before
        hashed = sent.select(*dml.MESSAGE, tx.content_hash(
            F.col("workspace_id"), F.col("session_id"), tx.strip_nul(F.col("content"))).alias("content_hash"))
        keepers = dml.unique_content(cut_lineage(hashed), ["workspace_id", "content_hash"], [F.col("message_id")],
                                     self._stored_for(sent).select("workspace_id", "content_hash"))
        # whole messages are left out before they are cut into chunks
        fresh = dml.to_chunks(sent.join(keepers.select(*dml.MESSAGE), dml.MESSAGE, "left_semi"))
        if self.auto_tag:  # K5
            fresh = tagged(fresh, self.brain)
        ready = cut_lineage(embed_rows(fresh, self.embedder, inflight=self.settings.embed_inflight))
        # a message written again: what its old text had beyond the new one goes
        tail = cut_lineage(dml.stale_tail(self._stored_for(sent).select("id", *dml.MESSAGE, "chunk_index"), ready.select(*dml.MESSAGE, "total_chunks")))
        self._put(ready)
        self._drop(tail)
        return checked.select("workspace_id", "message_id", "session_id", "role", F.col("error").isNull().alias("stored"), "error")

    def start_ingest(self, messages: DataFrame, checkpoint: str, **trigger):
        """L2 as a stream. Ids follow from the messages, so a batch that runs again changes
        nothing."""
        return (messages.writeStream.option("checkpointLocation", checkpoint)
                .foreachBatch(lambda batch, _: self.add_batch(batch) and None)
                .trigger(**(trigger or {"processingTime": "2 seconds"})).start())

    def import_workspace(self, path: str, workspace: str) -> DataFrame:
        """An exported workspace, written as messages; returns their receipts."""
        return self.add_batch(files.import_workspace(self.spark, path, self._own(workspace)))

    def message_sizes(self, workspace: str) -> DataFrame:
        """The chunks of each message."""
        return stats.chunks_per_message(self._rows("chunks").where(F.col("workspace_id") == self._own(workspace)))

    def _stored_for(self, batch: DataFrame, most: int = 200) -> DataFrame:
        """The chunk rows of a batch's workspaces; a short list of them prunes the scan."""
        named = [r["workspace_id"] for r in batch.select("workspace_id").distinct().limit(most + 1).collect()]
        stored = self.tables.read("chunks")
        return stored if len(named) > most else stored.where(F.col("workspace_id").isin(named))

    def add_message(self, workspace: str, session: str, role: str, content: str, scope: str = "",
                    peer: str = "", metadata: dict | None = None, message_id: str | None = None) -> str:
        """L1."""
        row = self.spark.createDataFrame(
            [(message_id, workspace, session, role, content, scope, peer,
              {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in (metadata or {}).items()}, None)],
            schema.MESSAGES_IN)
        receipt = self.add_batch(row, MAX_CONTENT_BYTES).first()
        if not receipt["stored"]:
            raise ValueError(receipt["error"])
        return receipt["message_id"]

    def upload(self, workspace: str, session: str, content: str) -> str:
        """Uploads are system messages."""
        return self.add_message(workspace, session, "system", content)

    def messages(self, workspace: str, session: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
        """L7, F8."""
        rows = self._rows("chunks").drop("embedding").where(
            predicates.equals(workspace_id=self._own(workspace), session_id=session))
        return page(rows, [F.col("created_at"), F.col("message_id"), F.col("chunk_index")],
                    search.wanted(limit, 20), max(offset, 0))

    def message(self, workspace: str, message_id: str) -> DataFrame:
        """A message's chunks in order."""
        return self._rows("chunks").drop("embedding").where(
            predicates.equals(workspace_id=self._own(workspace), message_id=message_id)).orderBy("chunk_index")

    def where(self, workspace: str, limit: int = 100, **values) -> DataFrame:
        """B10."""
        rows = self._rows("chunks").drop("embedding").where(
            predicates.equals(workspace_id=self._own(workspace), **values))
        return rows.orderBy("id").limit(limit if limit > 0 else 100)

    def query_metadata(self, workspace: str, tree: dict, limit: int = 100) -> DataFrame:
        """B10 with nested conditions: a predicate tree over the columns of chunks and, where rows have one, the map `extra`."""
        rows = self._rows("chunks").drop("embedding").where(predicates.equals(workspace_id=self._own(workspace)))
        found = rows.where(metadata.matches(tree, rows.columns, metadata.nested(F.col("extra"))))
        return found.orderBy("id").limit(limit if limit > 0 else 100)

    def delete_message(self, workspace: str, message_id: str) -> int:
        """L3."""
        gone = predicates.equals(workspace_id=self._own(workspace), message_id=message_id)
        count = self._rows("chunks").where(gone).count()
        if count:
            self._drop_where(gone)
        return count

    def update_messages(self, edits: DataFrame) -> None:
        """L4, L5, J12 for any number of messages: `edits` are (workspace_id, message_id, content) to
        replace a text or (workspace_id, message_id, sections) to splice it. Only chunks that changed are embedded again;
        chunks past the new end go. Nothing is written before the vectors exist."""
        self._apply(edits, tolerant=False)

    def _apply(self, edits: DataFrame, tolerant: bool) -> DataFrame:
        """The edits that were applied, by workspace and message. If `tolerant`, a message with a text that the provider
        refuses stays as it is; otherwise the first refusal is raised."""
        for c, t in (("content", "string"), ("sections", "map<string,string>")):
            edits = edits if c in edits.columns else edits.withColumn(c, F.lit(None).cast(t))
        own = self.tables.read("chunks").drop("embedding")
        if self.only:  # the shared workspace is read, not written
            own = own.where(F.col("workspace_id") == self.only)
        stored = cut_lineage(own.join(edits.select(*dml.MESSAGE), dml.MESSAGE, "left_semi"))
        old = dml.reassemble(stored)
        new = cut_lineage(old.join(edits, dml.MESSAGE).select(*dml.MESSAGE, "parts", F.when(
            F.col("content").isNotNull(), tx.strip_nul(F.col("content"))).otherwise(
                spliced(F.col("text"), F.col("sections"))["document"]).alias("text"))
            .withColumn("pieces", tx.chunk_plain(F.col("text"))))
        base = first_seen(stored.drop("id", "document", "total_chunks", "content_hash"), dml.MESSAGE,
                          [F.col("chunk_index")]).drop("chunk_index")
        new = new.join(base.select(*dml.MESSAGE, "session_id"), dml.MESSAGE).withColumn(
            "content_hash", tx.content_hash(F.col("workspace_id"), F.col("session_id"), F.col("text"))).drop("session_id", "text")
        plan = dml.chunk_diff(new, F.col("parts"), F.col("pieces")).withColumn(
            "id", F.concat("message_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")))
        rows = plan.where("action = 'write'").withColumn("total_chunks", F.size("pieces")).drop(
            "parts", "pieces", "action").join(base, dml.MESSAGE)
        made = cut_lineage(embed_rows(rows, self.embedder, inflight=self.settings.embed_inflight, tolerant=tolerant))
        refused = made.where("embedding IS NULL").select(*dml.MESSAGE).distinct()
        written = cut_lineage(made.join(refused, dml.MESSAGE, "left_anti"))
        tail = cut_lineage(plan.where("action = 'delete'").select("id", *dml.MESSAGE).join(refused, dml.MESSAGE, "left_anti"))
        self._put(written)
        self._drop(tail)
        return old.select(*dml.MESSAGE).join(refused, dml.MESSAGE, "left_anti")

    def update_message(self, workspace: str, message_id: str, content: str | None = None,
                       sections: dict[str, str] | None = None) -> None:
        if not self.message(workspace, message_id).take(1):
            raise NotFound("message not found")
        self.update_messages(self.spark.createDataFrame(
            [(self._own(workspace), message_id, content, sections)],
            "workspace_id STRING, message_id STRING, content STRING, sections MAP<STRING,STRING>"))

    def expire(self, workspace: str, older_than: str) -> int:
        """L6, J11."""
        limit = tx.parse_time(F.lit(older_than))
        if self.spark.range(1).select(limit.isNull().alias("bad")).first()["bad"]:
            raise ValueError("invalid date")
        gone = (F.col("workspace_id") == self._own(workspace)) & (F.col("created_at") < limit)
        count = self._rows("chunks").where(gone).count()
        self._drop_where(gone)
        return count

    # -- search ------------------------------------------------------------------------------
    def _scope(self, workspace, session="", role="", scope="", peer="") -> search.Scope:
        return search.Scope(self._own(workspace) if workspace or self.only else "", session, role, scope, peer,
                            self.settings.excluded_workspaces)

    def search(self, text: str, workspace: str = "", session: str = "", role: str = "", scope: str = "",
               peer: str = "", n: int = 10, hybrid: bool = False) -> DataFrame:
        """M1, M2 with the relevance floor; `rank` gives the order."""
        ask, seen = self._query(text), self._scope(workspace, session, role, scope, peer)
        plan = search.hybrid if hybrid else search.semantic
        hits = plan(self._chunks(), ask, search.wanted(n), seen, self.now())
        if self.settings.librarian_mode in ("hybrid", "ai") and not hybrid:
            hits = self._ai_reordered(text, hits)
        return search.floor(hits, self.settings.min_score)

    def _ai_reordered(self, text: str, hits: DataFrame) -> DataFrame:
        """K5: the model's order for three to ten hits."""
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        if not 3 <= len(rows) <= 10:
            return hits
        rows = [{**r, "rank": i} for i, r in enumerate(reorder(self.brain, text, rows))]
        return self.spark.createDataFrame([tuple(r[c] for c in hits.columns) for r in rows], hits.schema)

    def _chunks(self) -> DataFrame:
        return self._rows("chunks")

    def search_workspace(self, workspace: str, text: str, n: int = 5) -> DataFrame:
        """M4: without the floor."""
        return search.semantic(self._chunks(), self._query(text), search.wanted(n, 5), self._scope(workspace), self.now())

    def search_all(self, text: str, n: int = 10, hybrid: bool = True) -> DataFrame:
        """M3."""
        return search.search_all(self._chunks(), self._query(text), search.wanted(n), self.now(),
                                 self.settings.min_score, self.settings.excluded_workspaces, hybrid)

    def temporal(self, text: str, workspace: str, session: str = "", n: int = 10, offset: int = 0,
                 after: str | None = None, before: str | None = None) -> DataFrame:
        """M5."""
        return search.temporal(self._chunks(), self._query(text), search.wanted(n), max(offset, 0),
                               self._scope(workspace, session), self.now(), after, before)

    def grep(self, needle: str, workspace: str, session: str = "", limit: int = 50) -> DataFrame:
        """M6."""
        where = predicates.equals(workspace_id=self._own(workspace), session_id=session)
        rows = self._chunks().drop("embedding")
        if self.texts:  # only the texts that the index names are read
            rows = self.texts.texts_of(self.texts.candidates([needle], [self._own(workspace)]), rows)
        return search.grep(rows, needle, limit, where)

    # -- workspaces --------------------------------------------------------------------------
    def create_workspace(self, name: str, **extra) -> str:
        """A1, L9."""
        workspace = self._own(name)
        pairs = F.create_map(*[F.lit(str(x)) for kv in extra.items() for x in kv]).cast("map<string,string>")
        self.tables.merge("workspaces", self._one(
            {"workspace_id": workspace, "name": name, "created_at": self.now(), "extra": pairs}, "workspaces"))
        return workspace

    def workspaces(self) -> DataFrame:
        """A3: every workspace that was created or holds rows."""
        return self._rows("workspaces").select("workspace_id").unionByName(
            self._rows("chunks").select("workspace_id")).distinct()

    def delete_workspace(self, workspace: str) -> None:
        self.tables.drop_workspace(self._own(workspace))

    def analytics(self) -> DataFrame:
        """D3."""
        return stats.analytics(self._rows("chunks"))

    def workspace_health(self, workspace: str, embedding_status: str = "ok") -> DataFrame:
        """M15."""
        rows = self._rows("chunks").where(F.col("workspace_id") == self._own(workspace))
        held = rows.agg(F.count(F.lit(1)).alias("document_count"), F.count("workspace_id").alias("readable_rows"))
        info = self.embedder.info()
        return stats.health(held, embedding_status).select(
            F.lit(workspace).alias("workspace_id"), "*", F.lit(info["model"]).alias("embedding_model"),
            F.lit(info["dimension"]).alias("embedding_dim"), F.lit(embedding_status).alias("embedding"))

    def alive(self) -> bool:
        """A12."""
        return self.spark.range(1).count() == 1

    # -- sessions, scopes, peers -------------------------------------------------------------
    def create_session(self, workspace: str, session: str, peers: list[str] | None = None, scope: str = "") -> None:
        """L8."""
        self.tables.merge("sessions", self._one(
            {"workspace_id": self._own(workspace), "session_id": session, "peer_ids": self._texts(peers),
             "scope": scope, "created_at": self.now()}, "sessions"))

    def sessions(self, workspace: str) -> DataFrame:
        return self._rows("sessions").where(F.col("workspace_id") == self._own(workspace))

    def session_context(self, workspace: str, session: str, budget: int = CONTEXT_TOKENS) -> dict:
        """The representation and the newest messages that fit the budget beside it."""
        workspace = self._own(workspace)
        told = self.representation(workspace)
        rows = self._rows("chunks").where(predicates.equals(workspace_id=workspace, session_id=session))
        left = budget - (len(told.encode()) + 3) // 4
        if left < 0:
            return {"representation": told.encode()[: budget * 4].decode(errors="ignore"), "messages": None,
                    "total_tokens": budget}
        rows = rows.withColumn("message_id", F.col("id"))
        kept = context.within_budget(rows, left)
        used = kept.agg(F.coalesce(F.max("used"), F.lit(0)).alias("n")).first()["n"]
        kept = kept.join(rows.select("message_id", "chunk_index", "role", "document"), "message_id")
        return {"representation": told, "messages": kept.orderBy("created_at", "message_id", "chunk_index"),
                "total_tokens": used + budget - left}

    def observation_context(self, workspace: str, session: str, message_id: str, window: int = 2) -> DataFrame:
        """E2."""
        rows = self._rows("chunks").drop("embedding").where(
            predicates.equals(workspace_id=self._own(workspace), session_id=session))
        first = rows.where("chunk_index = 0")
        near = context.around(first, first.where(F.col("message_id") == message_id), window)
        return near.select("message_id", "offset").join(rows, "message_id").orderBy("offset", "chunk_index")

    def create_scope(self, workspace: str, name: str, sessions: list[str] | None = None) -> None:
        """L13."""
        self.tables.merge("scopes", self._one(
            {"workspace_id": self._own(workspace), "scope_name": name, "sessions": self._texts(sessions),
             "created_at": self.now()}, "scopes"))

    def scopes(self, workspace: str, name: str = "") -> DataFrame:
        return self._rows("scopes").where(predicates.equals(workspace_id=self._own(workspace), scope_name=name))

    def add_to_scope(self, workspace: str, name: str, sessions: list[str]) -> None:
        """An unknown scope is created."""
        if not self.scopes(workspace, name).take(1):
            return self.create_scope(workspace, name, sessions)
        self.tables.merge("scopes", cut_lineage(dml.add_sessions(self.scopes(workspace, name), name, sessions)))

    def remove_from_scope(self, workspace: str, name: str, session: str) -> None:
        self.tables.merge("scopes", cut_lineage(dml.remove_session(self.scopes(workspace, name), name, session)))

    def scope_messages(self, workspace: str, name: str) -> DataFrame:
        """C15."""
        return context.scope_rows(self._rows("chunks").drop("embedding"), self.scopes(workspace, name))

    def create_peer(self, workspace: str, peer: str) -> None:
        """L12."""
        self.tables.merge("peers", self._one(
            {"workspace_id": self._own(workspace), "peer_name": peer, "created_at": self.now()}, "peers"))

    def peers(self, workspace: str) -> DataFrame:
        return self._rows("peers").where(F.col("workspace_id") == self._own(workspace))

    def set_peer_card(self, workspace: str, peer: str, lines: list[str]) -> None:
        card = self._one({"workspace_id": self._own(workspace), "peer_id": peer, "lines": self._texts(lines),
                          "updated_at": self.now()}, "peer_cards")
        self.tables.merge("peer_cards", embed_rows(
            card.drop("embedding").withColumn("document", F.array_join("lines", "\n")), self.embedder))

    def peer_card(self, workspace: str, peer: str) -> list[str]:
        """C14."""
        row = self._rows("peer_cards").where(
            predicates.equals(workspace_id=self._own(workspace), peer_id=peer)).select("lines").first()
        return list(row["lines"]) if row else []

    # -- conclusions and provenance ----------------------------------------------------------
    def add_conclusions(self, rows: DataFrame) -> None:
        """(id, workspace_id, peer_id, document, source, session_id)."""
        stamped = rows if "created_at" in rows.columns else rows.withColumn("created_at", self.now())
        self.tables.merge("conclusions", embed_rows(stamped, self.embedder, inflight=self.settings.embed_inflight))

    def create_conclusion(self, workspace: str, peer: str, text: str, source: str = "", session: str = "") -> str:
        made = f"concl_{uuid.uuid4().hex}"
        self.add_conclusions(self._one(
            {"id": made, "workspace_id": self._own(workspace), "peer_id": peer, "document": text,
             "created_at": self.now(), "source": source, "session_id": session}, "conclusions").drop("embedding"))
        return made

    def conclusions(self, workspace: str, peer: str = "", limit: int = 25, offset: int = 0) -> DataFrame:
        rows = self._rows("conclusions").drop("embedding").where(
            predicates.equals(workspace_id=self._own(workspace), peer_id=peer))
        return page(rows, [F.col("created_at").desc(), F.col("id")], limit, offset)

    def delete_conclusion(self, workspace: str, conclusion: str) -> None:
        self.tables.delete_where("conclusions", predicates.equals(workspace_id=self._own(workspace), id=conclusion))

    def query_conclusions(self, workspace: str, text: str, n: int = 10) -> DataFrame:
        """M7."""
        return search.conclusions(self._rows("conclusions"), self._query(text).vector, search.wanted(n),
                                  self._own(workspace))

    def representation(self, workspace: str, peer: str = "", session: str = "", maximum: int = 25) -> str:
        """Conclusions, then the first messages of the session."""
        workspace = self._own(workspace)
        rows = self._rows("conclusions").where(predicates.equals(workspace_id=workspace, peer_id=peer))
        row = context.representation(rows, maximum).first()
        parts = [row["representation"]] if row else []
        if session:
            parts += [m["document"] for m in self.messages(workspace, session, 10).collect()]
        return "\n".join(parts)

    def add_reasoning(self, workspace: str, peer: str, conclusion: str, premises: list[str] | None = None,
                      messages: list[str] | None = None) -> None:
        """L11."""
        self.tables.merge("reasoning", self._one(
            {"id": f"edge_{uuid.uuid4().hex}", "workspace_id": self._own(workspace), "peer_id": peer,
             "conclusion_id": conclusion, "premise_ids": self._texts(premises),
             "supporting_message_ids": self._texts(messages), "created_at": self.now()}, "reasoning"))

    def _seed(self, id_: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(id_).alias("seed"), F.lit(id_).alias("id"))

    def _edges(self, workspace: str) -> DataFrame:
        return self._rows("reasoning").where(F.col("workspace_id") == self._own(workspace))

    def trace(self, workspace: str, conclusion: str, depth: int = TRACE_DEPTH, reverse: bool = False) -> DataFrame:
        """I1 with previews, or I2."""
        edges = self._edges(workspace)
        if reverse:
            return provenance.trace_reverse(edges, self._seed(conclusion), depth).orderBy("depth", "id")
        chunks = self._rows("chunks").where(F.col("workspace_id") == self._own(workspace))
        return provenance.with_previews(provenance.trace_forward(edges, self._seed(conclusion), depth), chunks)

    def reasoning_chain(self, workspace: str, conclusion: str) -> DataFrame:
        """I3."""
        return provenance.reasoning_chain(self._edges(workspace), self._seed(conclusion))

    def stale(self, workspace: str, max_age_days: int = 90, limit: int = 50) -> DataFrame:
        """M12."""
        mine = F.col("workspace_id") == self._own(workspace)
        found = stale.scan(self._rows("chunks").where(mine), self._rows("conclusions").where(mine),
                           self._rows("reasoning").where(mine), self.now(), max_age_days if max_age_days > 0 else 90)
        return stale.report(found, limit)

    def brief(self, workspace: str, maximum: int = 10) -> DataFrame:
        """D24."""
        mine = F.col("workspace_id") == self._own(workspace)
        return overview.brief(*[self._rows(t).where(mine) for t in ("chunks", "sessions", "conclusions", "reasoning")],
                              self.now(), maximum)

    # -- language model ----------------------------------------------------------------------
    def ask(self, question: str, workspace: str = "", session: str = "", context_text: str = "") -> str:
        """M8: answers from relevant hits only; without any it abstains."""
        if not question:
            raise ValueError("question is required")
        if not context_text and (workspace or session):
            hits = search.semantic(self._chunks(), self._query(question), 5, self._scope(workspace, session), self.now())
            context_text = search.context_text(hits, self.settings.min_score).first()["context"]
            if context_text is None:
                raise NotFound("no relevant context found")
        return self.brain.ask(question, context_text)

    def summarize(self, text: str = "", workspace: str = "", session: str = "", max_chars: int = 500) -> str:
        """M9."""
        if not text and (workspace or session):
            text = "\n".join(r["document"] for r in self.messages(workspace, session, 50).select("document").collect())
            if not text:
                raise NotFound("no messages found")
        if not text:
            raise ValueError("text, or workspace and session, is required")
        return self.brain.summarize(text, max_chars)

    def chat(self, workspace: str, query: str, observer: str = "", observed: str = "", session: str = "",
             level: str = "low") -> dict:
        """Answers with the help of tools, and remembers the answer when the context it
        began with was relevant."""
        if not query:
            raise ValueError("query required")
        observer = observer or observed or "default"
        observed = observed or observer
        tools, n, temperature = CHAT_LEVELS.get(level.lower(), CHAT_LEVELS["low"])
        cards = {p: self.peer_card(workspace, p) for p in {observer, observed}}
        hits = search.semantic(self._chunks(), self._query(query), n, self._scope(workspace, session), self.now())
        seeds = hits.orderBy("rank").collect()
        told = self.representation(workspace, observed, session, 5)
        seed = "\n\n".join(([f"Representation:\n{told}"] if told else []) + [h["document"] for h in seeds])
        seed = seed.encode()[:CHAT_CONTEXT_BYTES].decode(errors="ignore")
        log = [{"role": "system", "content": f"Observer {observer}, observed {observed}. Cards: {json.dumps(cards)}"},
               {"role": "user", "content": f"Context:\n{seed}\n\nQuestion: {query}"}]
        premises: list[str] = []
        supports: list[str] = []
        answer = ""
        for left in range(tools, -1, -1):
            answer = self.brain.chat(log, temperature)
            name, args = parse_tool(answer)
            if not name or left == 0:
                break
            found = [r.asDict() for r in self.tool(workspace, session, name, args).collect()]
            ids = [r["id"] for r in found if r.get("id")]
            if name == "search_memory":
                premises += ids
            elif name == "search_messages":
                supports += ids
            log += [{"role": "assistant", "content": answer},
                    {"role": "user", "content": f"Tool {name} result:\n{json.dumps(found, default=str)}\n\nContinue or answer."}]
        if answer and session and any(h["score"] >= self.settings.min_score for h in seeds):
            made = self.create_conclusion(workspace, observed, answer, "chat", session)
            self.add_reasoning(workspace, observed, made, premises, supports)
            self.add_message(workspace, session, "assistant", answer)
        return {"answer": answer, "observer": observer, "observed": observed}

    def tool(self, workspace: str, session: str, name: str, args: dict) -> DataFrame:
        """K4: the tools of a chat."""
        session = args.get("session_id") or session
        if name == "search_memory":
            hits = self.query_conclusions(workspace, args.get("query", ""), 5)
            return search.floor(hits, self.settings.min_score)
        if name == "search_messages":
            return self.search(args.get("query", ""), workspace, session, "", args.get("scope", ""),
                               args.get("peer_id", ""), 5)
        if name == "grep_messages":
            return self.grep(args.get("pattern") or args.get("query", ""), workspace, session, 10)
        if name == "get_reasoning_chain":
            return self.reasoning_chain(workspace, args.get("conclusion_id", ""))
        if name == "get_observation_context":
            return self.observation_context(workspace, session, args.get("chunk_id", "").split("_chunk_")[0])
        raise ValueError(f"unknown tool {name}")

    def stream_answer(self, payload: dict) -> str:
        """The frames of a server-sent event stream."""
        return f"data: {json.dumps(payload)}\n\ndata: [DONE]\n\n"

    # -- derivation --------------------------------------------------------------------------
    def derive(self, messages: DataFrame) -> None:
        """J1 on a batch."""
        self._store_derived(*feeds.derive(messages, self.brain, self.now()))

    def _store_derived(self, conclusions: DataFrame, edges: DataFrame) -> None:
        self.add_conclusions(conclusions)
        self.tables.merge("reasoning", edges)

    def start_deriver(self, messages: DataFrame, checkpoint: str, **trigger):
        return feeds.start_deriver(messages, self.brain, self._store_derived, checkpoint, **trigger)

    def dream_all(self) -> int:
        """J4 over every workspace, in one plan."""
        return self._dream(self._rows("chunks") if not self.only else self._rows("chunks").where(F.col("workspace_id") == self.only))

    def dream(self, workspace: str) -> int:
        """A summary of every session of three messages or more, unless a conclusion near
        to it is known. Returns how many were made."""
        return self._dream(self._rows("chunks").where(F.col("workspace_id") == self._own(workspace)))

    def _dream(self, rows: DataFrame) -> int:
        session = ["workspace_id", "session_id"]
        busy = rows.groupBy(*session).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DREAM_MIN_MESSAGES)
        # rows are told apart by chunk id, and each chunk counts with its own tokens
        mine = rows.join(busy, session, "left_semi").select(*session, F.col("id").alias("message_id"), "document", "created_at")
        kept = context.within_budget(mine, DREAM_TOKENS, tuple(session)).select(*dml.MESSAGE).join(mine, dml.MESSAGE)
        # bounded by the token budget
        texts = kept.groupBy(*session).agg(F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct("created_at", "message_id", "document"))), lambda m: m["document"]), "\n").alias("text"))
        probes = cut_lineage(embed_rows(texts.withColumn("document", F.col("text")), self.embedder))
        known = self._rows("conclusions").select("workspace_id", "embedding")
        # the shared workspace's conclusions are near to every workspace
        shared = knn.near_any(probes.withColumn("group", F.lit(SHARED_WORKSPACE)),
                              known.withColumnRenamed("workspace_id", "group"), session, DREAM_NEAREST, "group")
        near = knn.near_any(probes, known, session, DREAM_NEAREST).unionByName(shared).distinct()
        fresh = probes.join(near, session, "left_anti")
        made = fresh.select(
            *session, F.lit("").alias("peer_id"),
            feeds.summaries(F.col("text"), self.brain, 500).alias("document"), F.lit("dreamer").alias("source"),
            self.now().alias("created_at")).where("document <> ''").withColumn(
                "id", F.concat(F.lit("concl_"), F.left(F.sha2(F.concat_ws("|", "workspace_id", "session_id", "document"), 256), F.lit(24))))
        made, count = cut_and_count(made)
        if count:
            self.add_conclusions(made)
        return count

    # -- deferred updates --------------------------------------------------------------------
    def queue_updates(self, updates: DataFrame) -> None:
        """J5."""
        wanted = self.tables.schema("pending")
        full = updates.select(*[
            F.col(f.name) if f.name in updates.columns else
            (self.now() if f.name == "queued_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])
        self.tables.merge("pending", pending.enqueue(self.tables.read("pending").limit(0), full))

    def pending_updates(self, waiting_only: bool = False) -> DataFrame:
        """the queued updates, oldest first."""
        rows = self._rows("pending")
        return pending.ready(rows) if waiting_only else rows.orderBy("queued_at", "message_id")

    def start_inbox(self, updates: DataFrame, checkpoint: str, **trigger):
        """J5 as a stream."""
        return feeds.start_inbox(updates, self.tables, checkpoint, **trigger)

    def drain(self) -> dict:
        """Replays what is queued, each entry with an outcome of its own: applied, waiting for another
        try, or failed after its last. An entry without a workspace changes the message of the
        workspace first by name. A caller bound to a workspace replays that workspace's entries."""
        inbox = cut_lineage(pending.prune(self.tables.read("pending"), self.now()))
        waiting = inbox.where("status = 'pending'")
        if self.only:
            waiting = waiting.where(F.col("workspace_id") == self.only)
        stored = cut_lineage(self.tables.read("chunks").join(waiting.select("message_id"), "message_id", "left_semi")
                             .select(*dml.MESSAGE).distinct())
        owner = cut_lineage(stats.owning_workspace(stored)).withColumnRenamed("workspace_id", "owner")
        entry = waiting.join(owner, "message_id", "left").select(
            *[c for c in waiting.columns if c != "workspace_id"], F.col("workspace_id").alias("queued_for"),
            F.when(F.col("workspace_id") == pending.ANY_WORKSPACE, F.col("owner")).otherwise(F.col("workspace_id")).alias("workspace_id"))
        # of two entries that mean the same message the later one counts
        edits = cut_lineage(dml.latest(entry.join(stored, dml.MESSAGE, "left_semi").select(
            *dml.MESSAGE, F.nullif("content", F.lit("")).alias("content"), "sections", "queued_at", "queued_for"),
            dml.MESSAGE, ["queued_at", "queued_for"]))
        applied = cut_lineage(self._apply(edits.select(*dml.MESSAGE, "content", "sections"), tolerant=True))
        outcomes = (entry.join(stored.withColumn("there", F.lit(True)), dml.MESSAGE, "left")
                    .join(applied.withColumn("ok", F.lit(True)), dml.MESSAGE, "left")
                    .select(F.col("queued_for").alias("workspace_id"), "message_id",
                            F.when(F.col("there").isNull(), "message not found in any workspace")
                            .when(F.col("ok").isNull(), "embedding failed").alias("error")))
        after = cut_lineage(pending.settle(inbox, cut_lineage(outcomes), self.now()))
        self.tables.merge("pending", after)
        done = after.join(waiting.select(*dml.MESSAGE), dml.MESSAGE, "left_semi").groupBy("status").count().collect()
        counts = {r["status"]: r["count"] for r in done}
        return {"applied": counts.get("applied", 0), "requeued": counts.get("pending", 0), "failed": counts.get("failed", 0)}

    # -- code --------------------------------------------------------------------------------
    def index_code(self, workspace: str, path: str, roots: list[str] | None = None) -> DataFrame:
        """Indexes a source tree; files stored with their present hash are neither parsed nor stored
        again, and edges change only by what changed and removed files do to them. Returns the report."""
        workspace = self._own(workspace)
        seen = cut_lineage(files.scan_code(self.spark, path, roots))
        sources = cut_lineage(files.code_sources(seen, path).withColumn("file_hash", tx.file_hash(F.col("source"))))
        mine = self._rows("chunks").where(F.col("workspace_id") == workspace)
        held = self.tables.read("code_files").where(F.col("workspace_id") == workspace).drop("workspace_id")
        chunked = mine.where("source_path IS NOT NULL").select("source_path", "file_hash")
        listed = held.select(F.col("path").alias("source_path"), "file_hash")
        parsed = codegraph.parse(codegraph.changed_files(sources, chunked).unionByName(codegraph.changed_files(sources, listed))
                                 .dropDuplicates(["path"]).select("path", "source"))
        todo = cut_lineage(codegraph.changed_files(parsed, chunked))
        rows = codegraph.file_messages(todo).select(
            "message_id", F.lit(workspace).alias("workspace_id"), F.lit("code-index").alias("session_id"),
            F.lit("system").alias("role"), "content", F.lit(None).cast("string").alias("scope"),
            F.lit(None).cast("string").alias("peer_id"), self.now().alias("created_at"),
            F.create_map(
                F.lit("source_type"), F.lit("file"), F.lit("source_path"), F.col("source_path"),
                F.lit("language"), F.col("language"), F.lit("chunk_type"), F.lit("codefile"),
                F.lit("parent_doc_id"), F.col("source_path"), F.lit("file_hash"), F.col("file_hash"),
                F.lit("importance"), F.lit("3"), F.lit("agent"), F.lit("codeindex"),
                F.lit("entities"), F.array_join("entities", ",")).alias("metadata"))
        chunks = cut_lineage(embed_rows(dml.to_chunks(rows), self.embedder, inflight=self.settings.embed_inflight))
        gone = mine.where("chunk_type = 'codefile'").join(seen.select(F.col("path").alias("source_path")), "source_path", "left_anti")
        tail = dml.stale_tail(mine, chunks).select("id", *dml.MESSAGE).unionByName(gone.select("id", *dml.MESSAGE))
        tail = cut_lineage(tail.distinct())
        self._put(chunks)
        self._drop(tail)
        edges = self.tables.read("code_edges").where(F.col("workspace_id") == workspace)
        changed = cut_lineage(codegraph.postings(codegraph.changed_files(parsed, listed)))
        left = cut_lineage(held.select("path").join(sources.select("path"), "path", "left_anti"))
        ended, fresh = (cut_lineage(part) for part in codegraph.edge_rows_delta(edges, held, changed, left))
        named = fresh.withColumns({
            "workspace_id": F.lit(workspace),
            "id": tx.edge_id("codeedge_", *[F.col(c) for c in ("src", "rel", "dst")])})
        self.tables.delete("code_edges", ended)
        self.tables.merge("code_edges", first_seen(named, ["workspace_id", "id"], [F.col("file")]))
        # last, so that a run that breaks off before finds the same files changed again
        self.tables.delete("code_files", left.withColumn("workspace_id", F.lit(workspace)))
        self.tables.merge("code_files", changed.withColumn("workspace_id", F.lit(workspace)))
        edges = self.tables.read("code_edges").where(F.col("workspace_id") == workspace)
        return codegraph.index_report(seen, sources, todo, edges, MAX_CODE_FILE_BYTES)

    def symbols(self, workspace: str, file: str = "", limit: int = 200, offset: int = 0) -> DataFrame:
        """F10."""
        rows = self._rows("chunks").where(F.col("workspace_id") == self._own(workspace))
        return page(codegraph.file_symbols(rows, file), [F.col("file")], search.wanted(limit, 200), max(offset, 0))

    def callers(self, workspace: str, symbol: str) -> DataFrame:
        """I5."""
        return codegraph.callers(self._rows("code_edges").where(F.col("workspace_id") == self._own(workspace)), symbol)

    # -- graphs ------------------------------------------------------------------------------
    def graph_neighbours(self, path: str, nodes: list[str], hops: int = 1, n: int = 5) -> DataFrame:
        """I4: the first `n` nodes around the given ones in a stored graph."""
        _, edges = files.read_graph(self.spark, path)
        seeds = self.spark.createDataFrame([("seed", node, i) for i, node in enumerate(nodes)], "seed STRING, id STRING, position INT")
        return graph.expand(edges, seeds, hops, n, max(len(nodes), 1)).select("id", "hop", "position").orderBy("position")

    # -- vault -------------------------------------------------------------------------------
    def index_vault(self, workspace: str, root: str, known_entities: list[str] | None = None,
                    registry: DataFrame | None = None, reindex: bool = False) -> DataFrame:
        """Indexes changed Markdown files; returns the registry to keep."""
        workspace = self._own(workspace)
        found = cut_lineage(vault.scan(self.spark, root))
        todo = vault.changed(found, registry, reindex)
        rows = vault.messages(todo, workspace, known_entities or [])
        chunks = rows.withColumns({
            "id": F.concat("message_id", F.lit("_chunk_0")), "document": F.col("content"), "chunk_index": F.lit(0),
            "total_chunks": F.lit(1), "created_at": self.now(),
            "content_hash": tx.content_hash(F.col("workspace_id"), F.col("session_id"), F.col("content"))}).drop("content")
        chunks = cut_lineage(chunks)
        left = self.tables.read("chunks").where((F.col("workspace_id") == workspace) & (F.col("source_type") == "vault-md"))
        left = cut_lineage(vault.left_over(left, todo, chunks, found, registry))
        self._put(cut_lineage(embed_rows(chunks, self.embedder, inflight=self.settings.embed_inflight)))
        self._drop(left)
        return found.select("path", "digest")

    # -- usage, keys, webhooks ---------------------------------------------------------------
    def record_usage(self, lines: DataFrame) -> None:
        """Lines without an action are telemetry and are not kept."""
        self.tables.append("usage", lines.where(F.coalesce("action", F.lit("")) != ""))

    def load_usage(self, path: str) -> None:
        """A folder of usage lines."""
        self.record_usage(files.usage_log(self.spark, path))

    def record_requests(self, requests: DataFrame) -> None:
        """Requests (ts, method, path, source, agent, workspace) as usage lines."""
        self.record_usage(requests.withColumn("action", tx.classify_request(F.col("method"), F.col("path"))))

    def usage_daily(self, days: int = 30) -> DataFrame:
        """M14."""
        lines = usage.normalise(self.tables.read("usage"))
        today = F.to_date(F.from_utc_timestamp(self.now(), "Asia/Kuala_Lumpur"))
        return usage.last_days(usage.daily(usage.retained(lines, today, max(days, USAGE_RETENTION_DAYS))), today, days)

    def create_key(self, workspace: str) -> str:
        """L14."""
        key = "sk_" + secrets.token_hex(8)
        self.tables.merge("api_keys", self._one(
            {"id": key, "workspace_id": self._own(workspace), "prefix": key[:8], "created_at": self.now()}, "api_keys"))
        return key

    def keys(self, workspace: str = "") -> DataFrame:
        """B25."""
        return self._rows("api_keys").where(predicates.equals(workspace_id=workspace))

    def register_webhook(self, workspace: str, url: str, events: list[str] | None = None, resolve=None) -> None:
        """L14."""
        sinks.check_endpoint(url, resolve)
        self.tables.merge("webhooks", self._one(
            {"workspace_id": self._own(workspace), "url": url, "events": self._texts(events)}, "webhooks"))

    def webhooks(self, workspace: str, event: str = "") -> DataFrame:
        """The endpoints of a workspace, or those that an event goes to."""
        rows = self._rows("webhooks").where(F.col("workspace_id") == self._own(workspace))
        return sinks.subscribers(rows, event) if event else rows

    def fire(self, events: DataFrame, post) -> None:
        """A29."""
        sinks.deliver(sinks.deliveries(self.tables.read("webhooks"), events), post)

    # -- operations --------------------------------------------------------------------------
    def metrics(self) -> DataFrame:
        """One row of counters taken from the tables."""
        count = lambda t: self.tables.read(t).agg(F.count(F.lit(1)).alias("n")).scalar()
        queued = self.tables.read("pending").where("status = 'pending'").agg(F.count(F.lit(1)).alias("n")).scalar()
        return self.spark.range(1).select(
            count("chunks").alias("chunks_total"), count("conclusions").alias("conclusions_total"),
            count("reasoning").alias("reasoning_edges_total"), count("code_edges").alias("code_edges_total"),
            queued.alias("pending_updates"), F.lit(0).alias("dropped_total"))

    def evaluate(self, facts: DataFrame, queries: DataFrame, n: int = 10) -> float:
        """Stores the facts, asks all queries (workspace_id, query, expected) at once, and returns the recall."""
        self.add_batch(facts)
        asked = queries.select(F.monotonically_increasing_id().alias("q"), self._resolved("workspace_id"), F.col("query").alias("document"), "expected")
        if self.only and not asked.where(F.col("workspace_id") != self.only).isEmpty():
            raise PermissionError("workspace mismatch")
        asked = cut_lineage(embed_rows(cut_lineage(asked), self.embedder, inflight=self.settings.embed_inflight))
        return search.recall(self._chunks(), asked.drop("document"), n, self.now(), self.settings.min_score).first()["recall"]


def parse_tool(reply: str) -> tuple[str, dict]:
    """H36 for a single reply."""
    start, end = reply.find('{"tool"'), reply.rfind("}")
    if start < 0 or end < start:
        return "", {}
    try:
        call = json.loads(reply[start:end + 1])
    except ValueError:
        return "", {}
    return call.get("tool") or "", call.get("args") or {}
