"""The engine's tables as views over the driver's Parquet files (whole tables, fixed clock)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import spread

CLOCK = "2026-03-01 00:00:00"
QUERY_TEXT = "the ertion src1_en Doc3"


def now() -> Column:
    return F.lit(CLOCK).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, whose cost is in the work on each row."""
    return spread(table(spark, sf_dir, name))


def _workspace(n: Column) -> Column:
    group = F.pmod(n, F.lit(6))
    return (F.when(group == 0, "_global").when(group == 1, "finance")
            .otherwise(F.concat(F.lit("agent"), group.cast("string"))))


def _text(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return c.select(
        _text("m", conv, "_", turn).alias("message_id"), _text("s", conv).alias("session_id"),
        _workspace(conv).alias("workspace_id"), "role", F.col("text").alias("document"),
        F.timestamp_micros(F.unix_micros(start) + (F.pmod(conv, F.lit(128)) * 11 * 60 + turn) * 60_000_000)
        .alias("created_at"),
        (1 + F.pmod(conv * 7 + turn, F.lit(5))).cast("double").alias("importance"),
        conv, turn)


MESSAGES_SQL = """
msg AS (
  SELECT 'm' || conv_id || '_' || turn AS message_id, 's' || conv_id AS session_id,
         CASE conv_id % 6 WHEN 0 THEN '_global' WHEN 1 THEN 'finance'
              ELSE 'agent' || (conv_id % 6) END AS workspace_id,
         role, text AS document,
         TIMESTAMP '2026-01-01 00:00:00' + to_hours((conv_id % 128) * 11) + to_minutes(turn)
           AS created_at,
         (1 + (conv_id * 7 + turn) % 5)::DOUBLE AS importance, conv_id, turn
  FROM conversations)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with their metadata, without vectors."""
    d = texts(spark, sf_dir)
    n = F.col("doc_id")
    clock = F.unix_micros(now())
    return d.select(
        _text("d", n).alias("id"), _text("d", n).alias("message_id"), _workspace(n).alias("workspace_id"),
        _text("s", F.pmod(n, F.lit(50))).alias("session_id"),
        F.when(F.pmod(n, F.lit(7)) == 0, "system").otherwise("user").alias("role"),
        F.col("text").alias("document"),
        F.timestamp_micros(clock - F.pmod(n * 5, F.lit(2000)) * 3_600_000_000).alias("created_at"),
        (1 + F.pmod(n, F.lit(5))).cast("double").alias("importance"),
        F.concat_ws("/", "source", "lang").alias("header_path"),
        F.array(F.col("lang"), F.col("source"), F.lit("notes")).alias("tags"),
        F.array(_text("Doc", F.pmod(n, F.lit(10))), F.col("lang")).alias("entities"),
        n, "lang", "source")


NOTES_SQL = """
note AS (
  SELECT 'd' || doc_id AS id, 'd' || doc_id AS message_id,
         CASE doc_id % 6 WHEN 0 THEN '_global' WHEN 1 THEN 'finance'
              ELSE 'agent' || (doc_id % 6) END AS workspace_id,
         's' || (doc_id % 50) AS session_id,
         CASE WHEN doc_id % 7 = 0 THEN 'system' ELSE 'user' END AS role, text AS document,
         TIMESTAMP '2026-03-01 00:00:00' - to_hours((doc_id * 5) % 2000) AS created_at,
         (1 + doc_id % 5)::DOUBLE AS importance, source || '/' || lang AS header_path,
         [lang, source, 'notes'] AS tags, ['Doc' || (doc_id % 10), lang] AS entities,
         doc_id, lang, source
  FROM documents)"""


def vector_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with their vector where there is one (`embedding` is null elsewhere)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return notes(spark, sf_dir).join(vectors, "doc_id", "left")


VECTOR_NOTES_SQL = NOTES_SQL + """,
vnote AS (SELECT note.*, embedding FROM note LEFT JOIN embeddings ON vec_id = doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table with its label as workspace."""
    v = table(spark, sf_dir, "embeddings")
    label = F.col("label")
    return v.select(
        _text("v", F.col("vec_id")).alias("id"), "embedding",
        F.when(label == 0, "_global").when(label == 9, "Finance")
        .otherwise(_text("ws", label)).alias("workspace_id"), "vec_id")


VECTORS_SQL = """
vec AS (
  SELECT 'v' || vec_id AS id, embedding,
         CASE label WHEN 0 THEN '_global' WHEN 9 THEN 'Finance' ELSE 'ws' || label END
           AS workspace_id, vec_id
  FROM embeddings)"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The one vector used as the query; the filter on its key reaches the scan."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row["embedding"]]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage lines."""
    return usage_lines(table(spark, sf_dir, "events"))


def usage_lines(e: DataFrame) -> DataFrame:
    """`ts` is read without zone and means UTC."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    action = (F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "store")
              .when(F.col("event_type") == "purchase", "ask").when(F.col("event_type") == "signup", "chat")
              .otherwise(F.col("event_type")))
    source = F.when(k % 3 == 0, "mcp").when(k % 3 == 1, "dashboard").otherwise("")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), source.alias("source"),
        F.when(k % 4 == 0, "").otherwise(_text(" Agent #", F.pmod("user_id", F.lit(20)))).alias("agent"),
        F.when(k % 5 == 0, "").otherwise(_text("ws", k % 5)).alias("workspace"), "user_id", "event_id")


USAGE_SQL = """
raw_usage AS (
  SELECT ts, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'store'
                  WHEN 'purchase' THEN 'ask' WHEN 'signup' THEN 'chat' ELSE event_type END AS action,
         json_extract(props, '$.k')::BIGINT AS k, user_id, event_id
  FROM events),
line AS (
  SELECT ts, action, CASE k % 3 WHEN 0 THEN 'mcp' WHEN 1 THEN 'dashboard' ELSE '' END AS source,
         CASE WHEN k % 4 = 0 THEN '' ELSE ' Agent #' || (user_id % 20) END AS agent,
         CASE WHEN k % 5 = 0 THEN '' ELSE 'ws' || (k % 5) END AS workspace, user_id, event_id
  FROM raw_usage),
usage AS (
  SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, ts,
         CASE WHEN action IN ('search','store','ask','chat','code','upload') THEN action
              ELSE 'other' END AS action,
         CASE WHEN source = '' THEN 'api' ELSE source END AS source,
         CASE WHEN regexp_replace(lower(trim(agent)), '[^a-z0-9_-]', '', 'g') <> ''
              THEN left(regexp_replace(lower(trim(agent)), '[^a-z0-9_-]', '', 'g'), 32)
              WHEN source <> '' THEN source ELSE 'api' END AS agent,
         workspace, user_id, event_id
  FROM line)"""


def conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text as a conclusion; those of system turns are cited by no edge."""
    m = messages(spark, sf_dir)
    prefix = F.when(F.col("role") == "system", "x").otherwise("c")
    return m.select(
        F.concat(prefix, F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
        .alias("id"), "workspace_id", F.col("role").alias("peer_id"), "document", "created_at")


CONCLUSIONS_SQL = """
concl AS (
  SELECT CASE WHEN role = 'system' THEN 'x' ELSE 'c' END || conv_id || ':' || turn AS id,
         workspace_id, role AS peer_id, document, created_at
  FROM msg)"""


def reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a conclusion that rests on the turn before; the assistant's also on their
    own message."""
    m = messages(spark, sf_dir)
    conv, turn = F.col("conv_id"), F.col("turn")
    none = F.array().cast("array<string>")
    return m.select(
        _text("edge_", conv, "_", turn).alias("id"), "workspace_id",
        _text("c", conv, ":", turn).alias("conclusion_id"),
        F.when(turn > 0, F.array(_text("c", conv, ":", turn - 1))).otherwise(none).alias("premise_ids"),
        F.when(F.col("role") == "assistant", F.array(F.col("message_id"))).otherwise(none)
        .alias("supporting_message_ids"), "created_at", conv, turn)


REASONING_SQL = MESSAGES_SQL + """,
edge AS (
  SELECT 'edge_' || conv_id || '_' || turn AS id, workspace_id,
         'c' || conv_id || ':' || turn AS conclusion_id,
         CASE WHEN turn > 0 THEN ['c' || conv_id || ':' || (turn - 1)] ELSE []::VARCHAR[] END
           AS premise_ids,
         CASE WHEN role = 'assistant' THEN [message_id] ELSE []::VARCHAR[] END
           AS supporting_message_ids, created_at, conv_id, turn
  FROM msg)"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files: a title, a body, a code fence and sections with links."""
    d = texts(spark, sf_dir)
    n = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("longterm", "howto", "topics", "misc")]),
                          (F.pmod(n, F.lit(4)) + 1).cast("int"))
    return d.select(
        n, F.concat(F.lit("team/vault/"), folder, F.lit("/"), F.col("source"), F.lit("/note"),
                    n.cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# Note Of "), F.col("source"), F.lit("\n\n"), F.col("text"),
                 F.lit("\n```\n# fenced, no header\n```\n### Deep Part\nmore\n## Links\nsee [[note"), F.pmod(n * 7, F.lit(100)).cast("string"),
                 F.lit("]] and [[ Home ]]\n\n## State\nlanguage "), F.col("lang"),
                 F.lit(" for Spark\n")).alias("text"))


VAULT_SQL = """
vault AS (
  SELECT doc_id, 'team/vault/' || ['longterm', 'howto', 'topics', 'misc'][(doc_id % 4 + 1)::INT]
           || '/' || source || '/note' || doc_id || '.md' AS path,
         '# Note Of ' || source || chr(10) || chr(10) || text || chr(10) || '```' || chr(10)
           || '# fenced, no header' || chr(10) || '```' || chr(10) || '### Deep Part' || chr(10)
           || 'more' || chr(10) || '## Links' || chr(10)
           || 'see [[note' || ((doc_id * 7) % 100) || ']] and [[ Home ]]' || chr(10) || chr(10)
           || '## State' || chr(10) || 'language ' || lang || ' for Spark' || chr(10) AS text
  FROM documents)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file per order: a handler that calls the functions of its parts and suppliers.
    Files of parts and suppliers define those functions."""
    lines = table(spark, sf_dir, "lineitem")
    calls = F.concat(F.lit("\tUsePart"), F.col("l_partkey").cast("string"), F.lit("(AskSupplier"),
                     F.col("l_suppkey").cast("string"), F.lit("())"))
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", calls.alias("call")))),
        lambda c: c["call"]), "\n")
    orders = lines.groupBy("l_orderkey").agg(body.alias("body")).select(
        _text("orders/o", F.col("l_orderkey"), ".go").alias("path"),
        F.concat(F.lit('package orders\n\nimport "fmt"\n\n// entry point\nfunc HandleOrder'),
                 F.col("l_orderkey").cast("string"), F.lit("() {\n"), F.col("body"),
                 F.lit("\n}\n")).alias("source"))
    parts = table(spark, sf_dir, "part").select(
        _text("parts/p", F.col("p_partkey"), ".py").alias("path"),
        F.concat(F.lit("import catalog\n\ndef UsePart"), F.col("p_partkey").cast("string"),
                 F.lit("(x):\n    return '"), F.col("p_brand"), F.lit("'\n")).alias("source"))
    suppliers = table(spark, sf_dir, "supplier").select(
        _text("suppliers/s", F.col("s_suppkey"), ".ts").alias("path"),
        F.concat(F.lit("import { q } from './q'\n\nexport function AskSupplier"),
                 F.col("s_suppkey").cast("string"), F.lit("() {\n  return q('"), F.col("s_name"),
                 F.lit("')\n}\n")).alias("source"))
    return orders.unionByName(parts).unionByName(suppliers)


CODE_SQL = """
file AS (
  SELECT 'orders/o' || l_orderkey || '.go' AS path, 'go' AS language, 'fmt' AS import,
         'HandleOrder' || l_orderkey AS name, 'func' AS kind,
         'func HandleOrder' || l_orderkey || '() {' || chr(10)
           || string_agg(chr(9) || 'UsePart' || l_partkey || '(AskSupplier' || l_suppkey || '())',
                         chr(10) ORDER BY l_linenumber,
                           chr(9) || 'UsePart' || l_partkey || '(AskSupplier' || l_suppkey || '())')
           || chr(10) || '}' AS body
  FROM lineitem GROUP BY l_orderkey
  UNION ALL
  SELECT 'parts/p' || p_partkey || '.py', 'python', 'catalog', 'UsePart' || p_partkey, 'func',
         'def UsePart' || p_partkey || '(x):' || chr(10) || '    return ''' || p_brand || ''''
           || chr(10)
  FROM part
  UNION ALL
  SELECT 'suppliers/s' || s_suppkey || '.ts', 'ts', './q', 'AskSupplier' || s_suppkey, 'func',
         'export function AskSupplier' || s_suppkey || '() {' || chr(10) || '  return q('''
           || s_name || ''')' || chr(10) || '}'
  FROM supplier)"""
