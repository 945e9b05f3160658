"""Registered text and document queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions.identifiers import identifier_tokens
from recollect.functions.markdown import markdown_chunks, sections, spliced
from recollect.operators import dml
from recollect.plans import fixtures as fx
from recollect.sources import vault as vault_source

KNOWN = ["Spark", "Catalyst", "Note"]
UPDATES = {" LINKS ": "gone", "New Part": "x\ny"}


def _docs(spark, sf):
    return fx.texts(spark, sf)


def _chunks(spark, sf):
    v = fx.vault(spark, sf)
    return v.select("doc_id", "path", F.posexplode(markdown_chunks(F.col("text"))).alias("i", "c")).select(
        "doc_id", "path", "i", "c.*")


def chunk_plain(spark, sf):
    parts = _docs(spark, sf).select("doc_id", F.posexplode(tx.chunk_plain(F.col("text"))).alias("i", "part"))
    return parts.select("doc_id", "i", F.char_length("part").alias("chars"), F.sha2("part", 256).alias("digest"))


def chunk_markdown(spark, sf):
    return _chunks(spark, sf).select("doc_id", "i", "header_path", "chunk_type",
                                     F.sha2("body", 256).alias("digest"))


def vault_messages(spark, sf):
    """Vault files as messages with their metadata."""
    files = fx.vault(spark, sf).select("path", "text")
    rows = vault_source.messages(files, "team", KNOWN)
    return rows.select(
        "source_path", "vault_chunk_id", "parent_doc_id", "doc_title", "header_path", "importance",
        F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "entities").alias("entities"),
        F.sha2("content", 256).alias("digest"), F.sha2("summary_1line", 256).alias("summary"),
        "file_hash")


def keyword_tags(spark, sf):
    v = fx.vault(spark, sf)
    tags = tx.keyword_tags(F.col("path"), F.col("text"))
    return v.select("doc_id", F.concat_ws(",", tags).alias("tags"))


def extract_entities(spark, sf):
    names = tx.extract_entities(F.col("text"), F.lit("Note Of/Deep Part"), KNOWN)
    return fx.vault(spark, sf).select("doc_id", F.concat_ws(",", names).alias("entities"))


def wikilinks(spark, sf):
    return fx.vault(spark, sf).select("doc_id", F.explode(tx.wikilinks(F.col("text"))).alias("link"))


def importance_for(spark, sf):
    return fx.vault(spark, sf).select("path", tx.importance_for(F.col("path")).alias("importance"))


def split_sections(spark, sf):
    s = fx.vault(spark, sf).select("doc_id", F.posexplode(sections(F.col("text"))).alias("i", "s"))
    return s.select("doc_id", "i", "s.heading", F.sha2("s.body", 256).alias("digest"))


def splice_sections(spark, sf):
    updates = F.create_map(*[F.lit(x) for kv in UPDATES.items() for x in kv])
    s = fx.vault(spark, sf).select("doc_id", spliced(F.col("text"), updates).alias("s"))
    return s.select("doc_id", F.sha2("s.document", 256).alias("digest"),
                    F.size(F.filter("s.changed", lambda c: c)).alias("changed"), "s.same")


def splice_plan(spark, sf):
    """C17: which chunks of each edited document are written, kept or dropped."""
    updates = F.create_map(F.lit("State"), F.lit("brief"))
    edits = fx.vault(spark, sf).select(F.col("path").alias("message_id"), "text",
                                       spliced(F.col("text"), updates)["document"].alias("edited"))
    plan = dml.chunk_diff(edits, tx.chunk_plain(F.col("text")), tx.chunk_plain(F.col("edited")))
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("chunks"),
                                      F.countDistinct("message_id").alias("messages"))


def content_hash_dedup(spark, sf):
    rows = fx.notes(spark, sf).select(
        "doc_id", tx.content_hash(F.col("workspace_id"), F.lit("s"), F.col("document")).alias("content_hash"))
    return dml.unique_content(rows, ["content_hash"], [F.col("doc_id")]).select("doc_id", "content_hash")


def hash_skip(spark, sf):
    """The documents without a quality label count as new, the others as registered."""
    d = _docs(spark, sf).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"),
                                tx.file_hash(F.col("text")).alias("digest"), "doc_id")
    registry = d.join(fx.table(spark, sf, "labels"), "doc_id", "left_semi").select("path", "digest")
    return vault_source.changed(d.drop("doc_id"), registry)


def canonical_workspace(spark, sf):
    v = fx.vault(spark, sf).select(F.concat(F.lit(" "), "path", F.lit(" ")).alias("name"))
    return v.select("name", tx.canonical_workspace(F.col("name")).alias("workspace"))


def session_file_names(spark, sf):
    v = fx.vault(spark, sf).select("path")
    return v.select("path", tx.session_file_name(F.col("path")).alias("file"),
                    tx.session_file_name(F.lit("///")).alias("fallback"))


def identifier_words(spark, sf):
    """H7 over the words of part names and types, counted."""
    p = fx.table(spark, sf, "part").select(F.concat_ws("Q", "p_brand", "p_name", "p_type").alias("t"))
    return p.select(F.explode(identifier_tokens(F.col("t"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


def file_languages(spark, sf):
    files = fx.code_files(spark, sf).select("path").unionByName(fx.vault(spark, sf).select("path"))
    return files.groupBy(tx.language_for(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def previews(spark, sf):
    """The first 300 bytes of each text, measured after the ellipsis."""
    shown = tx.preview(F.col("text"), 300)
    return _docs(spark, sf).select(
        "doc_id", (F.octet_length("text") > 300).alias("cut"), F.right(shown, F.lit(1)).alias("last"))


# --- the same in SQL --------------------------------------------------------------------------

_LINES = """
ln AS (SELECT doc_id, path, i, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS line FROM (
         SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS i,
                len(string_split(text, chr(10))) AS n FROM vault)
       WHERE NOT (i = n AND line = ''))"""

MARKDOWN_SQL = f"""
{fx.VAULT_SQL},{_LINES},
fenced AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END)
                       OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM ln),
marked AS (SELECT *, CASE WHEN NOT inside AND regexp_matches(line, '^#{{1,3}}\\s')
                          THEN length(regexp_extract(line, '^#+')) END AS level FROM fenced),
placed AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM marked),
heads AS (SELECT doc_id, sec, level, trim(regexp_extract(line, '^#+\\s+(.*)', 1)) AS title
          FROM placed WHERE level IS NOT NULL),
trail(doc_id, sec, titles) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::VARCHAR[] FROM vault
  UNION ALL
  SELECT t.doc_id, h.sec, list_concat(t.titles[1:h.level - 1], [h.title])
  FROM trail t JOIN heads h ON h.doc_id = t.doc_id AND h.sec = t.sec + 1),
body AS (SELECT p.doc_id, any_value(p.path) AS path, p.sec, string_agg(line, '' ORDER BY i) AS body
         FROM placed p WHERE level IS NULL GROUP BY 1, 3),
win(doc_id, path, sec, body, start, stop) AS (
  SELECT doc_id, path, sec, body, 0::BIGINT,
         CASE WHEN length(body) > 4800 AND contains(substr(body, 3601, 1200), ' ')
              THEN 3600 + length(regexp_extract(substr(body, 3601, 1200), '(?s)^(.*) ', 1))
              ELSE least(4800, length(body)) END
  FROM body
  UNION ALL
  SELECT doc_id, path, sec, body, s,
         CASE WHEN length(body) > s + 4800 AND contains(substr(body, s + 3601, 1200), ' ')
              THEN s + 3600 + length(regexp_extract(substr(body, s + 3601, 1200), '(?s)^(.*) ', 1))
              ELSE least(s + 4800, length(body)) END
  FROM (SELECT *, greatest(stop - 200, start + 1) AS s FROM win WHERE stop < length(body))),
chunk AS (SELECT doc_id, path, array_to_string(titles, '/') AS header_path,
                 CASE WHEN len(titles) > 0 THEN 'section_h' || len(titles) ELSE 'prose' END AS chunk_type,
                 substr(body, start + 1, stop - start) AS body,
                 row_number() OVER (PARTITION BY doc_id ORDER BY sec, start) - 1 AS i
          FROM win JOIN trail USING (doc_id, sec))"""

_SECTIONS = f"""
{fx.VAULT_SQL},{_LINES},
h2 AS (SELECT *, CASE WHEN regexp_matches(line, '^##\\s+\\S') THEN 1 END AS head FROM ln),
sec AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h2),
part AS (SELECT doc_id, s, coalesce(any_value(rtrim(line, chr(10))) FILTER (head = 1), '') AS heading,
                coalesce(string_agg(line, '' ORDER BY i) FILTER (head IS NULL), '') AS body
         FROM sec GROUP BY 1, 2)"""

_TITLES = r"list_filter(regexp_extract_all({c}, '\b[A-Z][a-z]{{2,}}(?:[A-Z][a-z]+)*\b'), lambda x: NOT list_contains({k}, x))"


def _entities(text, header):
    """Known names, then title words in order of first use (none of the known ones)."""
    known = f"list_filter(['Spark', 'Catalyst', 'Note'], lambda k: contains({text}, k))"
    titled = _TITLES.format(c=header, k=known)
    return (f"array_to_string(list_concat({known}, list_filter({titled}, "
            f"lambda x, p: list_position({titled}, x) = p)), ',')")


def _tags(expr):
    words = f"list_transform(regexp_extract_all({expr}, '[A-Za-z]{{3,}}'), lambda w: lower(w))"
    return (f"array_to_string((list_filter({words}, lambda x, p: list_position({words}, x) = p))[1:12], ',')")


ORACLE = {
    "chunk_plain": """WITH RECURSIVE
w(doc_id, text, i, pos, part, jump) AS (
  SELECT doc_id, text, 0, 1::BIGINT, NULL::VARCHAR, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, text, i + 1, pos + CASE WHEN done THEN length(text) + 1
                                         WHEN blank THEN length(head) + 1 ELSE 6000 END,
         CASE WHEN NOT done AND blank THEN head ELSE win END, 0
  FROM (SELECT *, strlen(text) <= 6000 OR pos + 6000 > length(text) AS done,
               CASE WHEN strlen(text) <= 6000 THEN text ELSE substr(text, pos, 6000) END AS win,
               regexp_extract(substr(text, pos, 6000), '(?s)^(.*) ', 1) AS head,
               strlen(regexp_extract(substr(text, pos, 6000), '(?s)^(.*) ', 1)) > 3000 AS blank
        FROM w WHERE i = 0 OR pos <= length(text)))
SELECT doc_id, i - 1 AS i, length(part) AS chars, sha256(part) AS digest FROM w WHERE i > 0""",
    "chunk_markdown": f"""WITH RECURSIVE {MARKDOWN_SQL}
SELECT doc_id, i, header_path, chunk_type, sha256(body) AS digest FROM chunk""",
    "vault_messages": f"""WITH RECURSIVE {MARKDOWN_SQL}
SELECT path AS source_path, left(sha256(path), 16) || ':' || i AS vault_chunk_id,
       left(sha256(path), 16) AS parent_doc_id, regexp_extract(path, '([^/]*)\\.md$', 1) AS doc_title,
       header_path, CASE WHEN path LIKE '%longterm%' THEN 5 WHEN path LIKE '%howto%' THEN 4
                         WHEN path LIKE '%topics%' THEN 3 ELSE 2 END::DOUBLE AS importance,
       {_tags("path || ' ' || header_path")} AS tags, {_entities('body', 'header_path')} AS entities,
       sha256(CASE WHEN header_path <> '' THEN '# ' || header_path || chr(10) || body ELSE body END) AS digest,
       sha256(left(trim(regexp_extract(body, '[^\\n]*\\S[^\\n]*'), ' ' || chr(9)), 200)) AS summary,
       (SELECT sha256(text) FROM vault WHERE vault.doc_id = chunk.doc_id) AS file_hash
FROM chunk""",
    "keyword_tags": f"""WITH {fx.VAULT_SQL}
SELECT doc_id, {_tags("path || ' ' || text")} AS tags FROM vault""",
    "extract_entities": f"""WITH {fx.VAULT_SQL}
SELECT doc_id, {_entities('text', "'Note Of/Deep Part'")} AS entities FROM vault""",
    "wikilinks": f"""WITH {fx.VAULT_SQL}
SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1))) AS link FROM vault""",
    "importance_for": f"""WITH {fx.VAULT_SQL}
SELECT path, CASE WHEN regexp_matches(path, 'longterm|decisions') THEN 5
                  WHEN regexp_matches(path, 'howto|shared') THEN 4
                  WHEN regexp_matches(path, 'topics|reference|projects') THEN 3 ELSE 2 END AS importance
FROM vault""",
    "split_sections": f"""WITH {_SECTIONS}
SELECT doc_id, s AS i, heading, sha256(body) AS digest FROM part""",
    "splice_sections": f"""WITH {_SECTIONS},
edited AS (SELECT doc_id, s, heading, CASE WHEN heading = '## Links'
             THEN 'gone' || regexp_extract(body, '\\n*$') ELSE body END AS body FROM part)
SELECT doc_id, sha256(string_agg(CASE WHEN s = 0 THEN body ELSE heading || chr(10) || body END, ''
                                 ORDER BY s) || '## New Part' || chr(10) || 'x' || chr(10) || 'y' || chr(10))
         AS digest, 2 AS changed, false AS same FROM edited GROUP BY 1""",
    "splice_plan": f"""WITH RECURSIVE {fx.VAULT_SQL},
texts AS (SELECT path, 'old' AS v, text FROM vault
          UNION ALL
          SELECT path, 'new', regexp_extract(text, '(?s)^(.*\\n## State\\n)', 1) || 'brief' || chr(10) FROM vault),
w(path, v, text, i, pos, part) AS (
  SELECT path, v, text, 0, 1::BIGINT, NULL::VARCHAR FROM texts
  UNION ALL
  SELECT path, v, text, i + 1, pos + CASE WHEN done THEN length(text) + 1
                                          WHEN blank THEN length(head) + 1 ELSE 6000 END,
         CASE WHEN NOT done AND blank THEN head ELSE win END
  FROM (SELECT *, strlen(text) <= 6000 OR pos + 6000 > length(text) AS done,
               CASE WHEN strlen(text) <= 6000 THEN text ELSE substr(text, pos, 6000) END AS win,
               regexp_extract(substr(text, pos, 6000), '(?s)^(.*) ', 1) AS head,
               strlen(regexp_extract(substr(text, pos, 6000), '(?s)^(.*) ', 1)) > 3000 AS blank
        FROM w WHERE i = 0 OR pos <= length(text))),
o AS (SELECT path, i, part FROM w WHERE v = 'old' AND i > 0),
n AS (SELECT path, i, part FROM w WHERE v = 'new' AND i > 0),
j AS (SELECT path, CASE WHEN n.part IS NULL THEN 'delete' WHEN o.part = n.part THEN 'keep'
                        ELSE 'write' END AS action FROM o FULL JOIN n USING (path, i))
SELECT action, count(*) AS chunks, count(DISTINCT path) AS messages FROM j GROUP BY 1""",
    "content_hash_dedup": f"""WITH {fx.NOTES_SQL}
SELECT min(doc_id) AS doc_id, sha256(workspace_id || '|s|' || document) AS content_hash FROM note GROUP BY 2""",
    "hash_skip": """SELECT 'd/' || doc_id AS path, left(sha256(text), 16) AS digest FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "canonical_workspace": f"""WITH {fx.VAULT_SQL}
SELECT ' ' || path || ' ' AS name,
       trim(regexp_replace(replace(replace(lower(path), '-', '_'), ' ', '_'), '[^a-z0-9_]', '', 'g'), '_')
         AS workspace FROM vault""",
    "session_file_names": f"""WITH {fx.VAULT_SQL}
SELECT path, regexp_replace(path, '[^a-zA-Z0-9_-]', '_', 'g') AS file,
       'session_' || left(sha256('///'), 16) AS fallback FROM vault""",
    "file_languages": f"""WITH {fx.CODE_SQL}
SELECT language, count(*) AS n FROM file GROUP BY 1
UNION ALL SELECT 'markdown', count(*) FROM documents""",
    "previews": """SELECT doc_id, strlen(text) > 300 AS cut,
       CASE WHEN strlen(text) > 300 THEN '…' ELSE right(text, 1) END AS last FROM documents""",
}

QUERIES = {name: globals()[name] for name in [*ORACLE, "identifier_words"]}
