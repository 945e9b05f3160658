"""Registered write-side, inbox and streaming queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.engine import Memory
from recollect.functions import text as tx
from recollect.operators import dml, fingerprints, knn, limiter, metadata, pending, predicates
from recollect.plans import fixtures as fx
from recollect.settings import MAX_CONTENT_BYTES
from recollect.sources import sinks
from recollect.sources.brain import ExtractiveBrain
from recollect.sources.embedding import HashingEmbedder, embed_rows
from recollect.streaming import feeds
from recollect.streaming.groups import in_groups


def _rows(spark, sf):
    return fx.messages(spark, sf).select("message_id", "workspace_id", "role", "created_at",
                                         F.sha2("document", 256).alias("digest"))


def upsert(spark, sf):
    """Assistant rows are written again with a new digest; system rows come in under new ids."""
    rows = _rows(spark, sf)
    again = rows.where("role = 'assistant'").withColumn("digest", F.lit("new"))
    added = rows.where("role = 'system'").withColumn("message_id", F.concat(F.lit("n"), "message_id"))
    return dml.upsert(rows, again.unionByName(added), ["message_id"]).select("message_id", "role", "digest")


def delete_message(spark, sf):
    rows = _rows(spark, sf)
    return dml.delete(rows, rows.where("role = 'system'"), ["message_id"]).select("message_id")


def ttl_delete(spark, sf):
    kept = dml.expire(_rows(spark, sf), F.lit("2026-01-20 00:00:00").cast("timestamp"))
    return kept.select("message_id")


def update_prune(spark, sf):
    """L4: documents rewritten to their first piece; the rest of their chunks goes."""
    d = fx.texts(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"), "text")
    d = d.withColumn("workspace_id", F.lit("w"))
    stored = d.select(*dml.MESSAGE, F.posexplode(tx.chunk_plain(F.col("text"), 1000)).alias("chunk_index", "part"))
    short = d.select(*dml.MESSAGE, F.lit(1).alias("total_chunks"))
    return dml.stale_tail(stored, short).groupBy("message_id").agg(F.count(F.lit(1)).alias("dropped"))


def message_chunks(spark, sf):
    """L1, L2: documents as messages, validated and cut into chunk rows."""
    d = fx.notes(spark, sf)
    sent = d.select(
        "message_id", "workspace_id", "session_id",
        F.when(F.col("doc_id") % 11 == 0, "robot").otherwise(F.col("role")).alias("role"),
        F.col("document").alias("content"), F.lit("").alias("scope"), F.lit(None).cast("string").alias("peer_id"),
        F.create_map(F.lit("source_path"), F.col("source"), F.lit("secret"), F.lit("x"),
                     F.lit("importance"), F.lit("4")).alias("metadata"), "created_at")
    fine = predicates.validate_messages(sent).where("error IS NULL").drop("error")
    rows = dml.to_chunks(fine)
    return rows.select("id", "message_id", "workspace_id", "role", "chunk_index", "total_chunks",
                       "content_hash", "source_path", "importance", F.sha2("document", 256).alias("digest"))


def message_errors(spark, sf):
    """What is wrong with messages that are wrong, by the rules of a service's edge."""
    d = fx.notes(spark, sf)
    sent = d.select(
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("workspace_id")).alias("workspace_id"),
        F.when(F.col("doc_id") % 7 == 0, "bad id").otherwise(F.col("session_id")).alias("session_id"),
        F.when(F.col("doc_id") % 11 == 0, "robot").when(F.col("doc_id") % 13 == 0, "")
        .otherwise("user").alias("role"), F.col("document").alias("content"),
        F.lit(None).cast("map<string,string>").alias("metadata"))
    return predicates.validate_messages(sent, MAX_CONTENT_BYTES).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def metadata_query(spark, sf):
    """A tree over a column and two levels of nested metadata."""
    d = fx.table(spark, sf, "documents").select(
        "doc_id", "lang", F.create_map(
            F.lit("stats"), F.to_json(F.struct("n_chars", F.struct("source").alias("origin"))),
            F.lit("rank"), F.pmod("doc_id", F.lit(5)).cast("string")).alias("extra"))
    tree = {"$or": [{"lang": {"$in": ["de", "en"]}, "stats.n_chars": {"$gte": 2000}},
                    {"rank": 3, "stats.origin.source": {"$ne": "src1"}}]}
    return d.where(metadata.matches(tree, d.columns, metadata.nested(F.col("extra")))).select("doc_id")


def metadata_depth_errors(spark, sf):
    """Messages whose metadata has up to eight levels."""
    levels = F.pmod("doc_id", F.lit(8)).cast("int")
    inner = F.concat(F.repeat(F.lit('{"a":'), levels), F.lit("1"), F.repeat(F.lit("}"), levels))
    sent = fx.notes(spark, sf).select("doc_id", "workspace_id", "session_id", "role", F.col("document").alias("content"),
                                      F.create_map(F.lit("m"), inner).alias("metadata"))
    return predicates.validate_messages(sent).select("doc_id", "error")


def reassembled(spark, sf):
    d = fx.texts(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"), "text")
    pieces = d.select(F.lit("w").alias("workspace_id"), "message_id", F.posexplode(F.split("text", "(?<=\n)")).alias("chunk_index", "document"))
    stored = pieces.withColumn("id", F.concat_ws("_", "message_id", "chunk_index"))
    return dml.reassemble(stored).select("message_id", F.sha2("text", 256).alias("digest"))


def set_except(spark, sf):
    """Workspaces and sessions that hold messages of the user but none of the system."""
    m = fx.messages(spark, sf).select("workspace_id", "session_id", "role")
    return dml.missing(m.where("role = 'user'"), m.where("role = 'system'"), ["workspace_id", "session_id"])


def set_union_scopes(spark, sf):
    scopes = fx.messages(spark, sf).groupBy("workspace_id").agg(
        F.array_sort(F.collect_set("role")).alias("sessions")).withColumn("scope_name", F.lit("main"))
    grown = dml.add_sessions(scopes, "main", ["user", "guest"])
    cut = dml.remove_session(grown, "main", "assistant")
    return cut.select("workspace_id", F.concat_ws(",", F.array_sort("sessions")).alias("sessions"))


def reconcile(spark, sf):
    """Live customers per nation next to a copy without negative balances."""
    c = fx.table(spark, sf, "customer")
    return dml.reconcile(c, c.where("c_acctbal >= 0"), "c_mktsegment")


def _updates(spark, sf):
    e = fx.table(spark, sf, "events")
    none = F.lit(None)
    return e.select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("message_id"), F.lit("w").alias("workspace_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
        .alias("content"), none.cast("map<string,string>").alias("sections"),
        none.cast("string").alias("session_id"), none.cast("string").alias("role"),
        none.cast("map<string,string>").alias("metadata"), none.cast("string").alias("requester"),
        F.col("ts").cast("timestamp").alias("queued_at"), F.lit("pending").alias("status"),
        F.lit(3).alias("attempts"), none.cast("string").alias("last_error"),
        none.cast("timestamp").alias("applied_at"))


def pending_latest_wins(spark, sf):
    u = _updates(spark, sf)
    inbox = pending.enqueue(u.limit(0), u, ["queued_at", "content"])
    return inbox.select("message_id", "content", "status", "attempts")


def pending_replay(spark, sf):
    """A replay in which entries of odd users fail, the third failure being the last."""
    u = _updates(spark, sf)
    inbox = dml.latest(u.where("content <> ''"), dml.MESSAGE, ["queued_at", "content"]).select(*u.columns)
    odd = F.substring("message_id", 2, 20).cast("bigint") % 2 == 1
    outcomes = inbox.select(*dml.MESSAGE, F.when(odd, "no vector").alias("error"))
    after = pending.settle(inbox, outcomes, fx.now(), 4)
    return after.select("message_id", "status", "attempts", "last_error")


def rate_limit_decisions(spark, sf):
    """Two requests an hour for each user."""
    done = limiter.decisions(fx.usage(spark, sf), "user_id", F.col("ts"), 2, 3600)
    return done.select("user_id", "us", "accepted")


def session_blocks(spark, sf):
    m = fx.messages(spark, sf).withColumnRenamed("document", "content")
    blocks = sinks.turn_blocks(m, ("agent2",))
    return blocks.select("file", "message_id", F.sha2("block", 256).alias("digest"))


def webhook_deliveries(spark, sf):
    """Every user message announced to the endpoints of its workspace."""
    m = fx.messages(spark, sf)
    endpoints = m.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).select(
        "workspace_id", F.explode(F.array(
            F.struct(F.lit("http://all").alias("url"), F.array().cast("array<string>").alias("events")),
            F.struct(F.lit("http://new").alias("url"), F.array(F.lit("message.created")).alias("events")),
            F.struct(F.lit("http://gone").alias("url"), F.array(F.lit("message.deleted")).alias("events"))))
        .alias("e")).select("workspace_id", "e.*")
    events = m.where("role = 'user'").select("workspace_id", F.lit("message.created").alias("event"),
                                             F.struct(F.col("message_id").alias("id")).alias("data"))
    return sinks.deliveries(endpoints, events)


def provider_recoveries(spark, sf):
    """Users as providers that are down at each error event."""
    e = fx.table(spark, sf, "events")
    probes = e.groupBy("user_id", "ts").agg(F.max(F.col("event_type") == "error").alias("down")).select(
        F.col("user_id").alias("provider"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("down"), "degraded").otherwise("ok").alias("status"))
    return feeds.recoveries(probes)


def derived_conclusions(spark, sf):
    """J1 over all conversations with the offline model: conclusions and messages behind them."""
    m = fx.messages(spark, sf).select("message_id", "workspace_id", F.col("role").alias("peer_id"),
                                      F.col("document").alias("content"), "created_at")
    made, edges = feeds.derive(m, ExtractiveBrain(), fx.now())
    cited = edges.select(F.col("conclusion_id").alias("id"), F.size("supporting_message_ids").alias("messages"))
    return made.join(cited, "id").groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("conclusions"), F.sum("messages").alias("citations"))


def embedded_documents(spark, sf):
    """K1 over all documents: how far each lies from the first words of the query."""
    model = HashingEmbedder(64)
    rows = embed_rows(fx.notes(spark, sf).select("id", "document"), model)
    near = knn.with_distance(rows, model.embed_one("the nation and the thing"))
    return near.select("id", F.round("distance", 4).alias("distance"))


def stream_usage_daily(spark, sf):
    """Usage counted as a stream, read back when the stream has ended."""
    source = fx.table(spark, sf, "events").schema
    events = feeds.parquet_stream(spark, sf, source, glob="events.parquet")
    lines = fx.usage_lines(events)
    out, log = feeds.scratch(spark, "usage"), feeds.scratch(spark, "usage-log")
    feeds.start_counts(lines, out, log).awaitTermination()
    return feeds.total_counts(spark, out, ["day", "agent", "action"])


def _unique(spark, events):
    rows = events.select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("created_at"))
    out, log = feeds.scratch(spark, "dedup"), feeds.scratch(spark, "dedup-log")
    feeds.start_unique(rows, ["user_id", "event_type"], [F.col("created_at"), F.col("event_id")], out, log).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


def stream_dedup(spark, sf):
    """Distinct user and event type, deduplicated as a stream."""
    source = fx.table(spark, sf, "events").schema
    return _unique(spark, feeds.parquet_stream(spark, sf, source, glob="events.parquet"))


def _shuffled(spark, sf):
    """The events as a stream of files, one in a batch, whose times go forth and back."""
    events = fx.table(spark, sf, "events")
    folder = feeds.scratch(spark, "late")
    events.repartition(6, F.date_trunc("week", "ts")).write.parquet(folder)
    return feeds.parquet_stream(spark, folder, events.schema, files_per_trigger=1)


def stream_usage_late(spark, sf):
    """The same counts when whole weeks come late."""
    out, log = feeds.scratch(spark, "usage"), feeds.scratch(spark, "usage-log")
    feeds.start_counts(fx.usage_lines(_shuffled(spark, sf)), out, log).awaitTermination()
    return feeds.total_counts(spark, out, ["day", "agent", "action"])


def stream_dedup_late(spark, sf):
    return _unique(spark, _shuffled(spark, sf))


def stream_groups_of_five(spark, sf):
    """All messages as a stream of three batches; a workspace's messages leave in fives that reach over
    batches, the rest waits."""
    feed, out, log = feeds.scratch(spark, "feed"), feeds.scratch(spark, "fives"), feeds.scratch(spark, "fives-log")
    m = fx.messages(spark, sf).select("message_id", "workspace_id", F.col("role").alias("peer_id"),
                                      F.col("document").alias("content"), "created_at")
    m.repartition(3, "message_id").write.parquet(feed)
    grouped = in_groups(feeds.parquet_stream(spark, feed, m.schema, files_per_trigger=1), wait=None)
    (grouped.select("workspace_id", "group", "message_id").writeStream.option("checkpointLocation", log)
     .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out).groupBy("workspace_id", "group").agg(F.countDistinct("message_id").alias("n")).groupBy(
        "workspace_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("messages"),
                            F.min("n").alias("smallest"), F.max("group").alias("last_group"))


def _memory(spark):
    return Memory(spark, feeds.scratch(spark, "memory"), HashingEmbedder(16), buckets=2)


def _shared_ids(spark, sf):
    """Documents as messages whose ids come again in every workspace."""
    return fx.notes(spark, sf).select(
        F.concat(F.lit("m"), F.floor(F.col("doc_id") / 6).cast("string")).alias("message_id"), "workspace_id",
        F.lit("s").alias("session_id"), "role", F.col("document").alias("content"), "created_at")


def _first_chunks(memory):
    """The first chunk of each message; its hash is of the whole content."""
    return memory.tables.read("chunks").where("chunk_index = 0").select(*dml.MESSAGE, "content_hash")


def batch_write_shared_ids(spark, sf):
    """L2: each workspace keeps its own message of an id; repeated content is stored once in it."""
    memory = _memory(spark)
    memory.add_batch(_shared_ids(spark, sf))
    return _first_chunks(memory)


def update_in_one_workspace(spark, sf):
    """L4: an edit changes the message of its own workspace only."""
    memory = _memory(spark)
    sent = _shared_ids(spark, sf)
    memory.add_batch(sent)
    memory.update_messages(sent.where("workspace_id = 'agent2'").select(
        *dml.MESSAGE, F.concat(F.lit("new text of "), "message_id").alias("content")))
    return _first_chunks(memory)


def rewrite_message(spark, sf):
    """L2: a message written again has its new text only, however long the old one was."""
    memory = _memory(spark)
    sent = _shared_ids(spark, sf)
    memory.add_batch(sent)
    memory.add_batch(sent.where("workspace_id = 'agent2'").withColumn("content", F.concat(F.lit("short text of "), "message_id")))
    return memory.tables.read("chunks").groupBy(*dml.MESSAGE).agg(
        F.max("content_hash").alias("content_hash"), (F.count(F.lit(1)) == F.max("total_chunks")).alias("complete"),
        (F.min("content_hash") == F.max("content_hash")).alias("of_one_text"))


def session_blocks_shared_ids(spark, sf):
    """Ids that come again in other workspaces are turns of their own."""
    m = fx.messages(spark, sf).withColumnRenamed("document", "content").withColumn(
        "message_id", F.concat(F.lit("m"), F.floor(F.col("conv_id") / 6).cast("string"), F.lit("_"), F.col("turn").cast("string")))
    blocks = sinks.turn_blocks(m, ("agent2",))
    return blocks.select("file", "message_id", F.sha2("block", 256).alias("digest"))


def set_equality(spark, sf):
    """Orders next to a copy in which some changed by one byte, some are missing and some stand twice or were added."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    copy = o.where(key % 89 != 0).withColumn("o_orderstatus", F.when(key % 97 == 0, "~").otherwise(F.col("o_orderstatus")))
    copy = copy.unionByName(o.where(key % 83 == 0)).unionByName(o.where(key % 101 == 0).withColumn("o_orderkey", -key))
    return fingerprints.differences(o, copy.repartition(3), ["o_orderkey"])


# --- the same in SQL --------------------------------------------------------------------------

_ROWS = fx.MESSAGES_SQL + ", r AS (SELECT message_id, role, created_at, sha256(document) AS digest FROM msg)"
_PENDING = """
u AS (SELECT 'm' || user_id AS message_id, 'v' || event_id AS content, ts FROM events
      WHERE event_type <> 'error'),
last AS (SELECT message_id, arg_max(content, (ts, content)) AS content FROM u GROUP BY 1)"""
_STORED = """
stored AS (SELECT workspace_id, 'm' || (doc_id // 6) AS message_id, document FROM note WHERE document <> ''
           QUALIFY row_number() OVER (PARTITION BY workspace_id, document ORDER BY 'm' || (doc_id // 6)) = 1)"""
_CUT = """
w(doc_id, text, i, pos, part) AS (
  SELECT doc_id, text, 0, 1::BIGINT, NULL::VARCHAR FROM documents
  UNION ALL
  SELECT doc_id, text, i + 1, pos + CASE WHEN done THEN length(text) + 1
                                         WHEN blank THEN length(head) + 1 ELSE {size} END,
         CASE WHEN NOT done AND blank THEN head ELSE win END
  FROM (SELECT *, strlen(text) <= {size} OR pos + {size} > length(text) AS done,
               CASE WHEN strlen(text) <= {size} THEN text ELSE substr(text, pos, {size}) END AS win,
               regexp_extract(substr(text, pos, {size}), '(?s)^(.*) ', 1) AS head,
               strlen(regexp_extract(substr(text, pos, {size}), '(?s)^(.*) ', 1)) > {size} // 2 AS blank
        FROM w WHERE i = 0 OR pos <= length(text)))"""

ORACLE = {
    "upsert": f"""WITH {_ROWS}
SELECT message_id, role, CASE WHEN role = 'assistant' THEN 'new' ELSE digest END AS digest FROM r
UNION ALL SELECT 'n' || message_id, role, digest FROM r WHERE role = 'system'""",
    "delete_message": f"WITH {_ROWS} SELECT message_id FROM r WHERE role <> 'system'",
    "ttl_delete": f"WITH {_ROWS} SELECT message_id FROM r WHERE created_at >= TIMESTAMP '2026-01-20'",
    "update_prune": f"""WITH RECURSIVE {_CUT.format(size=1000)}
SELECT 'd' || doc_id AS message_id, count(*) AS dropped FROM w WHERE i > 1 GROUP BY 1""",
    "message_chunks": f"""WITH RECURSIVE {fx.NOTES_SQL}, {_CUT.format(size=6000)}
SELECT note.id || '_chunk_' || (i - 1) AS id, message_id, workspace_id, role, i - 1 AS chunk_index,
       count(*) OVER (PARTITION BY doc_id) AS total_chunks,
       sha256(workspace_id || '|' || session_id || '|' || document) AS content_hash,
       source AS source_path, 4.0::DOUBLE AS importance, sha256(part) AS digest
FROM note JOIN w USING (doc_id) WHERE i > 0 AND doc_id % 11 <> 0""",
    "message_errors": """WITH m AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'robot' WHEN doc_id % 13 = 0 THEN '' ELSE 'user' END AS role,
         text FROM documents)
SELECT CASE WHEN role = '' OR text = '' THEN 'session_id, role and content are required'
            WHEN role = 'robot' THEN 'role must be ''user'', ''assistant'', or ''system'''
            WHEN strlen(text) > 100000 THEN 'content too large'
            WHEN doc_id % 5 = 0 THEN 'workspace_id is required'
            WHEN doc_id % 7 = 0 THEN 'invalid id format' END AS error, count(*) AS n
FROM m GROUP BY 1""",
    "reassembled": "SELECT 'd' || doc_id AS message_id, sha256(text) AS digest FROM documents",
    "set_except": f"""WITH {fx.MESSAGES_SQL}
SELECT workspace_id, session_id FROM msg WHERE role = 'user'
EXCEPT SELECT workspace_id, session_id FROM msg WHERE role = 'system'""",
    "set_union_scopes": f"""WITH {fx.MESSAGES_SQL}, s AS (
  SELECT DISTINCT workspace_id, role FROM msg
  UNION SELECT DISTINCT workspace_id, unnest(['user', 'guest']) FROM msg)
SELECT workspace_id, string_agg(role, ',' ORDER BY role) AS sessions FROM s WHERE role <> 'assistant' GROUP BY 1""",
    "reconcile": """WITH a AS (SELECT c_mktsegment, count(*) AS live_rows FROM customer GROUP BY 1),
b AS (SELECT c_mktsegment, count(*) AS restored_rows FROM customer WHERE c_acctbal >= 0 GROUP BY 1)
SELECT c_mktsegment, live_rows, restored_rows,
       CASE WHEN restored_rows IS NULL THEN 'missing' WHEN live_rows IS NULL THEN 'extra'
            WHEN live_rows = restored_rows THEN 'equal' ELSE 'differs' END AS status
FROM a FULL JOIN b USING (c_mktsegment)""",
    "pending_latest_wins": f"""WITH {_PENDING}
SELECT message_id, content, 'pending' AS status, 0 AS attempts FROM last""",
    "pending_replay": f"""WITH {_PENDING}
SELECT message_id, CASE WHEN substr(message_id, 2)::BIGINT % 2 = 1 THEN 'failed' ELSE 'applied' END AS status,
       CASE WHEN substr(message_id, 2)::BIGINT % 2 = 1 THEN 4 ELSE 3 END AS attempts,
       CASE WHEN substr(message_id, 2)::BIGINT % 2 = 1 THEN 'no vector' END AS last_error FROM last""",
    "rate_limit_decisions": """WITH RECURSIVE
e AS (SELECT user_id, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM e),
w(user_id, rn, us, accepted, passed) AS (
  SELECT user_id, rn, us, least(n, 2), list_transform(range(least(n, 2)), lambda x: us) FROM o WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, us, least(n, 2 - len(live)),
         list_concat(live, list_transform(range(least(n, 2 - len(live))), lambda x: us))
  FROM (SELECT o.user_id, o.rn, o.us, o.n,
               list_filter(w.passed, lambda p: p > o.us - 3600000000) AS live
        FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1))
SELECT user_id, us, accepted FROM w""",
    "session_blocks": f"""WITH {fx.MESSAGES_SQL}, b AS (
  SELECT *, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM msg)
SELECT CASE WHEN workspace_id = 'agent2' THEN 'agent2' ELSE '_shared/knowledge/' || workspace_id END
         || '/vault/10-memory/sessions/' || session_id || '.md' AS file, message_id,
       sha256('## ' || stamp || ' · ' || role || ' · ' || message_id || chr(10) || chr(10) || document || chr(10)
              || chr(10) || '<!-- turn:' || message_id || ' -->' || chr(10) || chr(10)) AS digest FROM b""",
    "session_blocks_shared_ids": f"""WITH {fx.MESSAGES_SQL}, b AS (
  SELECT * REPLACE ('m' || (conv_id // 6) || '_' || turn AS message_id), strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM msg)
SELECT CASE WHEN workspace_id = 'agent2' THEN 'agent2' ELSE '_shared/knowledge/' || workspace_id END
         || '/vault/10-memory/sessions/' || session_id || '.md' AS file, message_id,
       sha256('## ' || stamp || ' · ' || role || ' · ' || message_id || chr(10) || chr(10) || document || chr(10)
              || chr(10) || '<!-- turn:' || message_id || ' -->' || chr(10) || chr(10)) AS digest FROM b""",
    "webhook_deliveries": f"""WITH {fx.MESSAGES_SQL}
SELECT unnest(['http://all', 'http://new']) AS url,
       '{{"event":"message.created","workspace_id":"' || workspace_id || '","data":{{"id":"' || message_id || '"}}}}'
         AS payload FROM msg WHERE role = 'user'""",
    "provider_recoveries": """WITH p AS (
  SELECT user_id AS provider, epoch_us(ts) AS "at", CASE WHEN max(event_type = 'error') THEN 'degraded'
         ELSE 'ok' END AS status FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(status) OVER (PARTITION BY provider ORDER BY "at") AS before FROM p)
SELECT provider, "at", status FROM l WHERE status = 'ok' AND before IS DISTINCT FROM 'ok'""",
    "stream_usage_daily": f"WITH {fx.USAGE_SQL} SELECT day, agent, action, count(*) AS n FROM usage GROUP BY ALL",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_usage_late": f"WITH {fx.USAGE_SQL} SELECT day, agent, action, count(*) AS n FROM usage GROUP BY ALL",
    "metadata_query": """SELECT doc_id FROM documents WHERE (lang IN ('de', 'en') AND n_chars >= 2000)
   OR (doc_id % 5 = 3 AND source IS DISTINCT FROM 'src1')""",
    "metadata_depth_errors": """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'session_id, role and content are required'
       WHEN doc_id % 8 >= 5 THEN 'invalid metadata: metadata depth >5' END AS error FROM documents""",
    "stream_groups_of_five": f"""WITH {fx.MESSAGES_SQL}, n AS (SELECT workspace_id, count(*) // 5 AS groups FROM msg GROUP BY 1)
SELECT workspace_id, groups, groups * 5 AS messages, 5 AS smallest, groups - 1 AS last_group FROM n WHERE groups > 0""",
    "stream_dedup_late": "SELECT DISTINCT user_id, event_type FROM events",
    "batch_write_shared_ids": f"""WITH {fx.NOTES_SQL}, {_STORED}
SELECT workspace_id, message_id, sha256(workspace_id || '|s|' || document) AS content_hash FROM stored""",
    "set_equality": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
copy AS (SELECT * REPLACE (CASE WHEN o_orderkey % 97 = 0 THEN '~' ELSE o_orderstatus END AS o_orderstatus) FROM o WHERE o_orderkey % 89 <> 0
         UNION ALL SELECT * FROM o WHERE o_orderkey % 83 = 0 UNION ALL SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM o WHERE o_orderkey % 101 = 0),
a AS (SELECT o_orderkey, list_sort(list(o::VARCHAR)) AS r FROM o GROUP BY 1), b AS (SELECT o_orderkey, list_sort(list(copy::VARCHAR)) AS r FROM copy GROUP BY 1)
SELECT o_orderkey, coalesce(len(a.r), 0) AS live_rows, coalesce(len(b.r), 0) AS restored_rows,
       CASE WHEN b.r IS NULL THEN 'missing' WHEN a.r IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (o_orderkey) WHERE a.r IS DISTINCT FROM b.r""",
    "rewrite_message": f"""WITH {fx.NOTES_SQL}, {_STORED}, now AS (
SELECT workspace_id, message_id, document FROM stored WHERE workspace_id <> 'agent2'
UNION ALL SELECT DISTINCT 'agent2', 'm' || (doc_id // 6), 'short text of m' || (doc_id // 6) FROM note WHERE workspace_id = 'agent2')
SELECT workspace_id, message_id, sha256(workspace_id || '|s|' || document) AS content_hash, true AS complete, true AS of_one_text FROM now""",
    "update_in_one_workspace": f"""WITH {fx.NOTES_SQL}, {_STORED}
SELECT workspace_id, message_id,
       sha256(workspace_id || '|s|' || CASE workspace_id WHEN 'agent2' THEN 'new text of ' || message_id ELSE document END)
         AS content_hash FROM stored""",
}

QUERIES = {name: globals()[name] for name in [*ORACLE, "derived_conclusions", "embedded_documents"]}
