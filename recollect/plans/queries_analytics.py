"""Registered analytics queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.text import classify_request
from recollect.operators import context, predicates, stale, stats, usage
from recollect.plans import brief as overview
from recollect.plans import fixtures as fx

PATHS = [
    ("GET", "/api/v1/health"), ("POST", "/api/v1/messages/search"), ("POST", "/api/v1/messages"),
    ("POST", "/api/v1/workspaces/w1/search"), ("GET", "/api/v1/sessions/s1/context"),
    ("POST", "/api/v1/messages/upload"), ("POST", "/api/v1/brain/ask"),
    ("GET", "/api/v1/workspaces/w1/chat/stream"), ("GET", "/api/v1/code/symbols"),
    ("POST", "/api/v1/code/index"), ("DELETE", "/api/v1/messages/m1"), ("GET", "/api/v1/keys"),
]


def _usage(spark, sf):
    return usage.normalise(fx.usage(spark, sf))


def usage_daily(spark, sf):
    return usage.daily(_usage(spark, sf))


def usage_by_agent_action(spark, sf):
    return usage.by_agent_action(_usage(spark, sf))


def usage_grouping_sets(spark, sf):
    return usage.by_dimension(_usage(spark, sf))


def usage_report(spark, sf):
    """The report with its maps, the maps opened again into rows."""
    maps = usage.report(_usage(spark, sf))
    outer = maps.select("day", "total", F.explode("by_agent_action").alias("agent", "m"))
    return outer.select("day", "total", "agent", F.explode("m").alias("action", "n"))


def usage_last_n_days(spark, sf):
    return usage.last_days(usage.daily(_usage(spark, sf)), F.lit("2024-02-10"), 45)


def usage_retained(spark, sf):
    kept = usage.retained(_usage(spark, sf), F.lit("2024-01-20"), 10)
    return kept.groupBy("day").agg(F.count(F.lit(1)).alias("lines"))


def classify_requests(spark, sf):
    i = (F.pmod("event_id", F.lit(len(PATHS))) + 1).cast("int")
    pick = lambda n: F.element_at(F.array(*[F.lit(p[n]) for p in PATHS]), i)
    rows = fx.table(spark, sf, "events").select(pick(0).alias("method"), pick(1).alias("path"))
    rows = rows.groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("action", classify_request(F.col("method"), F.col("path")))


def rate_limit_sliding(spark, sf):
    """Events of each user in the hour up to each event."""
    return usage.sliding_count(fx.usage(spark, sf), "user_id", F.col("ts"), 3600).select(
        "user_id", F.unix_micros("ts").alias("us"), "in_window")


def workspace_stats(spark, sf):
    rows = fx.messages(spark, sf).unionByName(fx.notes(spark, sf), allowMissingColumns=True)
    return stats.health(stats.workspace_stats(rows))


def search_analytics(spark, sf):
    return stats.analytics(fx.notes(spark, sf))


def entity_topk(spark, sf):
    rows = fx.notes(spark, sf).withColumn("words", F.split(F.lower("document"), r"[^a-z0-9]+"))
    return stats.entity_top(rows, 10, "words")


def tokens_used(spark, sf):
    return stats.tokens_used(fx.messages(spark, sf), ["workspace_id", "session_id"])


def message_owner(spark, sf):
    notes = fx.notes(spark, sf)
    moved = notes.withColumn("workspace_id", F.concat(F.lit("zz"), "workspace_id"))
    rows = notes.select("message_id", "workspace_id").unionByName(moved.select("message_id", "workspace_id"))
    return stats.owning_workspace(rows, F.lit("zzagent2"))


def recall_eval(spark, sf):
    asked = fx.table(spark, sf, "benchmark").select(
        "item_id", F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("expected"))
    found = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return stats.recall(asked, found, F.col("expected"), F.col("text"), "item_id").withColumn(
        "recall", F.round("recall", 6))


def workspace_names(spark, sf):
    """The workspaces among collection names, every other of which is a companion."""
    d = fx.table(spark, sf, "documents")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "_conclusions", "_reasoning", "_other")]),
                          (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    names = d.select(F.concat(F.lit("ws_"), "source", F.lit("_"), "lang", suffix).alias("name")).distinct()
    return predicates.workspaces_of(names)


def scoped_sessions(spark, sf):
    """Rows in a scope that names every third session, counted."""
    m = fx.messages(spark, sf)
    listed = m.where(F.col("role") == "system").groupBy("workspace_id").agg(
        F.collect_set("session_id").alias("sessions")).withColumn("scope_name", F.lit("system"))
    return context.scope_rows(m, listed).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("rows"))


def _stale(spark, sf, days=30):
    m = fx.messages(spark, sf).withColumn("chunk_index", F.lit(0))
    return stale.scan(m, fx.conclusions(spark, sf), fx.reasoning(spark, sf), fx.now(), days)


def stale_scan(spark, sf):
    return _stale(spark, sf).select("workspace_id", "id", "kind", "importance", "reason",
                                    F.round("age_days", 6).alias("age_days"))


def stale_report(spark, sf):
    return stale.report(_stale(spark, sf)).select("id", F.round("age_days", 6).alias("age_days"))


def session_context_budget(spark, sf):
    kept = context.within_budget(fx.messages(spark, sf), 300)
    return kept.select("session_id", "message_id", "newest", "used")


def observation_context(spark, sf):
    m = fx.messages(spark, sf).select("session_id", "message_id", "created_at", "role")
    around = context.around(m, m.where("role = 'system'"), 2)
    return around.select("target_id", "message_id", "offset")


def representation(spark, sf):
    return _representation(fx.conclusions(spark, sf))


def representation_shared_ids(spark, sf):
    """The same when every workspace has conclusions of the same ids."""
    m = fx.messages(spark, sf)
    shared = F.concat(F.floor(F.col("conv_id") / 6).cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return _representation(m.select(shared.alias("id"), "workspace_id", "document", "created_at"))


def _representation(rows):
    told = context.representation(rows, 25)
    return told.select("workspace_id", "conclusions", F.sha2("representation", 256).alias("digest"))


def brief(spark, sf):
    m = fx.messages(spark, sf).withColumns({
        "chunk_index": F.lit(0), "entities": F.array(F.col("role"), F.concat(F.lit("t"), F.col("turn").cast("string")))})
    rows = overview.brief(m, m, fx.conclusions(spark, sf), fx.reasoning(spark, sf), fx.now(), 10, 30)
    return rows.select("workspace_id", "document_count", "session_count", "conclusion_count",
                       "stale_count", F.concat_ws(",", "top_entities").alias("top_entities"),
                       F.sha2("representation", 256).alias("digest"))


# --- the same in SQL --------------------------------------------------------------------------

_COUNTERS = ", ".join(f"count(*) FILTER (action = '{a}') AS {n}" for a, n in usage.COUNTERS.items())
_TOKENS = "((strlen(document) + 3) // 4)"
_AGE = "((epoch_us(TIMESTAMP '2026-03-01 00:00:00') - epoch_us(created_at)) / 86.4e9)"
_STALE = fx.REASONING_SQL + "," + fx.CONCLUSIONS_SQL + f""",
cited AS (SELECT workspace_id, conclusion_id AS id FROM edge
          UNION SELECT workspace_id, unnest(premise_ids) FROM edge
          UNION SELECT workspace_id, unnest(supporting_message_ids) FROM edge),
cand AS (SELECT workspace_id, message_id AS id, 'message' AS kind, importance, created_at,
                CASE WHEN role = 'assistant'
                     THEN 'old assistant output, never cited as premise or support'
                     ELSE 'old, never reinforced by any reasoning edge' END AS reason
         FROM msg WHERE role <> 'system' AND importance < 4
         UNION ALL
         SELECT workspace_id, id, 'conclusion', 0.0, created_at,
                'old conclusion, never used as premise' FROM concl),
stale AS (SELECT *, {_AGE} AS age FROM cand
          WHERE created_at <= TIMESTAMP '2026-03-01 00:00:00' - INTERVAL 30 DAY
            AND NOT EXISTS (SELECT 1 FROM cited
                            WHERE cited.id = cand.id AND cited.workspace_id = cand.workspace_id))"""
_REPRESENTATION = """
told AS (SELECT workspace_id, string_agg('- ' || document, chr(10) ORDER BY rn) AS representation,
                count(*) AS conclusions
         FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id) AS rn
               FROM concl) WHERE rn <= {k} GROUP BY 1)"""
_CLASSIFY = """CASE
  WHEN path = '/api/v1/health' THEN NULL
  WHEN path LIKE '/api/v1/messages/search%' OR (path LIKE '%/search' AND path LIKE '%/workspaces/%')
    OR path LIKE '%/code/symbols' OR (path LIKE '%/context%' AND method = 'GET') THEN 'search'
  WHEN method = 'POST' AND path = '/api/v1/messages' THEN 'store'
  WHEN method = 'POST' AND path = '/api/v1/messages/upload' THEN 'upload'
  WHEN method = 'POST' AND path LIKE '%/brain/ask' THEN 'ask'
  WHEN path LIKE '%/chat%' AND method IN ('POST', 'GET') THEN 'chat'
  WHEN path LIKE '/api/v1/code/%' THEN 'code'
  WHEN method IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 'other' END"""

ORACLE = {
    "usage_daily": f"WITH {fx.USAGE_SQL} SELECT day, {_COUNTERS}, count(*) AS total FROM usage GROUP BY day",
    "usage_by_agent_action": f"WITH {fx.USAGE_SQL} SELECT day, agent, action, count(*) AS n FROM usage GROUP BY ALL",
    "usage_grouping_sets": f"""WITH {fx.USAGE_SQL}
SELECT day, 'source' AS dimension, source AS key, count(*) AS n FROM usage GROUP BY 1, 3
UNION ALL SELECT day, 'agent', agent, count(*) FROM usage GROUP BY 1, 3
UNION ALL SELECT day, 'workspace', workspace, count(*) FROM usage WHERE workspace <> '' GROUP BY 1, 3""",
    "usage_report": f"""WITH {fx.USAGE_SQL}
SELECT day, sum(count(*)) OVER (PARTITION BY day)::BIGINT AS total, agent, action, count(*) AS n
FROM usage GROUP BY day, agent, action""",
    "usage_last_n_days": f"""WITH {fx.USAGE_SQL},
d AS (SELECT strftime(x, '%Y-%m-%d') AS day
      FROM generate_series(TIMESTAMP '2024-02-10' - INTERVAL 44 DAY, TIMESTAMP '2024-02-10',
                           INTERVAL 1 DAY) AS g(x))
SELECT d.day, {_COUNTERS}, count(action) AS total FROM d LEFT JOIN usage USING (day) GROUP BY d.day""",
    "usage_retained": f"""WITH {fx.USAGE_SQL}
SELECT day, count(*) AS lines FROM usage WHERE day >= '2024-01-10' GROUP BY 1""",
    "classify_requests": f"""WITH p AS (
  SELECT {[m for m, _ in PATHS]}[(event_id % {len(PATHS)} + 1)::INT] AS method,
         {[p for _, p in PATHS]}[(event_id % {len(PATHS)} + 1)::INT] AS path FROM events)
SELECT method, path, count(*) AS n, {_CLASSIFY} AS action FROM p GROUP BY 1, 2""",
    "rate_limit_sliding": """
SELECT DISTINCT user_id, epoch_us(ts) AS us,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window
FROM events""",
    "workspace_stats": f"""WITH {fx.MESSAGES_SQL}, {fx.NOTES_SQL},
r AS (SELECT workspace_id FROM msg UNION ALL SELECT workspace_id FROM note)
SELECT trim(workspace_id, '_') AS workspace, count(*) AS document_count, count(*) AS readable_rows,
       'healthy' AS status FROM r GROUP BY 1""",
    "search_analytics": f"""WITH {fx.NOTES_SQL}
SELECT workspace_id, count(*) AS document_count FROM note GROUP BY ROLLUP (workspace_id)""",
    "entity_topk": """SELECT entity, count(*) AS n FROM
(SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS entity FROM documents)
WHERE entity <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "tokens_used": f"""WITH {fx.MESSAGES_SQL}
SELECT workspace_id, session_id, sum({_TOKENS})::BIGINT AS tokens FROM msg GROUP BY ALL""",
    "message_owner": f"""WITH {fx.NOTES_SQL}
SELECT message_id, CASE WHEN workspace_id = 'agent2' THEN 'zzagent2' ELSE workspace_id END
         AS workspace_id FROM note""",
    "recall_eval": """WITH j AS (
  SELECT item_id, coalesce(bool_or(contains(lower(d.text), lower(regexp_extract(b.text, '^([A-Za-z]+)', 1)))),
                           false) AS hit
  FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id GROUP BY 1)
SELECT count(*) FILTER (hit) AS hits, count(*) AS queries, round(avg(hit::INT), 6) AS recall FROM j""",
    "workspace_names": """WITH n AS (
  SELECT DISTINCT 'ws_' || source || '_' || lang
         || ['', '_conclusions', '_reasoning', '_other'][(doc_id % 4 + 1)::INT] AS name FROM documents)
SELECT substr(name, 4) AS workspace_id FROM n
WHERE NOT (regexp_matches(name, '(_conclusions|_reasoning|_codeedges)$')
           AND regexp_replace(name, '(_conclusions|_reasoning|_codeedges)$', '') IN (SELECT name FROM n))""",
    "scoped_sessions": f"""WITH {fx.MESSAGES_SQL}
SELECT workspace_id, count(*) AS rows FROM msg
WHERE (workspace_id, session_id) IN (SELECT (workspace_id, session_id) FROM msg WHERE role = 'system')
GROUP BY 1""",
    "stale_scan": f"""WITH {_STALE}
SELECT workspace_id, id, kind, importance, reason, round(age, 6) AS age_days FROM stale""",
    "stale_report": f"""WITH {_STALE}
SELECT id, round(age, 6) AS age_days FROM stale ORDER BY age DESC, id LIMIT 50""",
    "session_context_budget": f"""WITH {fx.MESSAGES_SQL},
w AS (SELECT session_id, message_id,
             row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS newest,
             sum({_TOKENS}) OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC
                                  ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM msg)
SELECT * FROM w WHERE used <= 300""",
    "observation_context": f"""WITH {fx.MESSAGES_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS p FROM msg)
SELECT t.message_id AS target_id, n.message_id, n.p - t.p AS offset
FROM n JOIN n t ON n.session_id = t.session_id AND abs(n.p - t.p) <= 2 WHERE t.role = 'system'""",
    "representation_shared_ids": f"""WITH {fx.MESSAGES_SQL},
concl AS (SELECT (conv_id // 6) || ':' || turn AS id, workspace_id, document, created_at FROM msg), {_REPRESENTATION.format(k=25)}
SELECT workspace_id, conclusions, sha256(representation) AS digest FROM told""",
    "representation": f"""WITH {fx.MESSAGES_SQL}, {fx.CONCLUSIONS_SQL}, {_REPRESENTATION.format(k=25)}
SELECT workspace_id, conclusions, sha256(representation) AS digest FROM told""",
    "brief": f"""WITH {_STALE}, {_REPRESENTATION.format(k=10)},
ent AS (SELECT workspace_id, string_agg(e, ',' ORDER BY n DESC, e) AS top_entities FROM (
          SELECT * FROM (SELECT workspace_id, e, count(*) AS n FROM (
            SELECT workspace_id, unnest([role, 't' || turn]) AS e FROM msg) GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY n DESC, e) <= 10) GROUP BY 1)
SELECT workspace_id, count(*) AS document_count, count(DISTINCT session_id) AS session_count,
       any_value(conclusions) AS conclusion_count,
       coalesce(any_value((SELECT count(*) FROM stale WHERE stale.workspace_id = msg.workspace_id)), 0)
         AS stale_count,
       any_value(top_entities) AS top_entities, sha256(any_value(representation)) AS digest
FROM msg LEFT JOIN told USING (workspace_id) LEFT JOIN ent USING (workspace_id) GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
