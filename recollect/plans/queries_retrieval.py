"""Registered retrieval queries and the SQL they are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.functions.identifiers import lex_tokens, query_terms
from recollect.functions.vectors import score
from recollect.operators import fusion, knn, lexical, predicates, skew
from recollect.plans import fixtures as fx
from recollect.plans import search
from recollect.session import checkpoint_dir
from recollect.sources.tables import Tables
from recollect.sources.text_index import TextIndex
from recollect.sources.vector_index import VectorIndex

N = 10
DREAM_NEAREST = 0.75  # about half of the vectors have one that near
FLOOR = 0.22


def _query(spark, sf, text=fx.QUERY_TEXT) -> search.Query:
    return search.Query(text, fx.query_vector(spark, sf))


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


def knn_topk(spark, sf):
    hits = knn.with_distance(fx.vectors(spark, sf), fx.query_vector(spark, sf))
    top = hits.orderBy("distance", "id").limit(N)
    return top.select("id", "workspace_id", _r("distance"))


def knn_scoped(spark, sf):
    hits = knn.with_distance(fx.vectors(spark, sf).where(predicates.visible(workspace="ws3")),
                             fx.query_vector(spark, sf))
    return hits.orderBy("distance", "id").limit(N).select("id", "workspace_id", _r("distance"))


def knn_excluded(spark, sf):
    hits = knn.with_distance(fx.vectors(spark, sf).where(predicates.visible(excluded=("finance",))),
                             fx.query_vector(spark, sf))
    return hits.orderBy("distance", "id").limit(N).select("id", "workspace_id", _r("distance"))


def _vector_index(spark, sf):
    rows = fx.vectors(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/recollect-index-{uuid.uuid4().hex}"
    return rows, VectorIndex.build(rows, path)


def _every_twentieth(rows):
    return rows.where("vec_id % 20 = 0").select(F.col("id").alias("q"), "embedding")


def knn_indexed(spark, sf):
    """The ten nearest rows of every twentieth vector, exact, through the inverted file."""
    rows, index = _vector_index(spark, sf)
    hits = index.search_many(_every_twentieth(rows), N, exact=True)
    return hits.select("q", "id", "workspace_id", _r("distance"))


def knn_index_recall(spark, sf):
    """The same queries by the probed lists alone, next to brute force: at least nine of ten neighbours are found."""
    rows, index = _vector_index(spark, sf)
    asked = _every_twentieth(rows)
    true = knn.top_matches(*knn.in_parts(asked, rows.select("id", "embedding")), ["q"], N, "part").select("q", "id", F.lit(1).alias("true"))
    got = index.search_many(asked, N).select("q", "id", F.lit(1).alias("got"))
    both = true.join(got, ["q", "id"], "left")
    return both.agg(F.countDistinct("q").alias("queries"), (F.count("got") >= 0.9 * F.count("true")).alias("recall_reached"))


def conclusion_search(spark, sf):
    hits = search.conclusions(fx.vectors(spark, sf), fx.query_vector(spark, sf), N, "ws2")
    return hits.select("id", "workspace_id", _r("distance"), _r("score"), "rank")


def vector_scores(spark, sf):
    """Distance, score and floor over the whole vector table."""
    rows = knn.with_distance(fx.vectors(spark, sf), fx.query_vector(spark, sf))
    return rows.select("id", _r("distance"), F.round(score(F.col("distance")), 6).alias("score"))


def bm25_topk(spark, sf):
    rows = fx.notes(spark, sf).select("id", "document")
    scored = lexical.bm25(rows, query_terms(fx.QUERY_TEXT)).select("id", "bm25")
    return scored.orderBy(F.col("bm25").desc(), "id").limit(20).select("id", _r("bm25"))


def bm25_scores(spark, sf):
    """Every scored text, with the corpus of its own workspace."""
    rows = fx.notes(spark, sf).select("id", "workspace_id", "document")
    scored = lexical.bm25(rows, query_terms(fx.QUERY_TEXT), ["workspace_id"])
    return scored.select("id", "workspace_id", _r("bm25"))


def bm25_df(spark, sf):
    terms = query_terms(fx.QUERY_TEXT)
    stats = lexical.corpus_stats(
        lexical.term_frequencies(fx.notes(spark, sf).select("document"), terms), terms)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"_df{i}").cast("bigint").alias("df"))
        for i, t in enumerate(terms)])).alias("p")
    return stats.select(pairs).select("p.*")


def bm25_corpus_stats(spark, sf):
    stats = lexical.corpus_stats(
        lexical.term_frequencies(fx.notes(spark, sf).select("workspace_id", "document"), []), [],
        ["workspace_id"])
    return stats.select("workspace_id", F.col("_docs").cast("bigint").alias("docs"),
                        F.round("_avg", 6).alias("average"))


def rrf_fusion(spark, sf):
    vec = knn.nearest(fx.vector_notes(spark, sf).select("id", "embedding"),
                      fx.query_vector(spark, sf), 2 * N)
    rows = fx.notes(spark, sf).select("id", "document")
    lex = skew.rank_bounded(lexical.bm25(rows, query_terms(fx.QUERY_TEXT)).select("id", "bm25"),
                            [F.col("bm25").desc(), F.col("id")], 2 * N)
    return fusion.rrf([vec, lex], ["id"]).select("id", _r("fused"))


def semantic_search(spark, sf):
    hits = search.semantic(fx.vector_notes(spark, sf), _query(spark, sf), 2 * N,
                           search.Scope(workspace="agent2"), fx.now())
    return hits.select("id", "workspace_id", _r("distance"), _r("score"), "rank", "source")


def workflow_rerank(spark, sf):
    """Rerank scores with every vector note as one hit set per workspace."""
    hits = knn.with_distance(fx.vector_notes(spark, sf), fx.query_vector(spark, sf))
    spread = hits.groupBy("workspace_id").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    scored = skew.join_lookup(hits, spread, ["workspace_id"], "inner")
    return scored.select("id", F.round(fusion.rerank_score(
        lex_tokens(fx.QUERY_TEXT), F.col("low"), F.col("high")), 6).alias("rerank"))


def dream_candidates(spark, sf):
    """Vectors of odd id that no vector of even id of their workspace is near to."""
    v = fx.vectors(spark, sf)
    odd, even = v.where("vec_id % 2 = 1"), v.where("vec_id % 2 = 0")
    near = knn.near_any(odd, even, ["id"], DREAM_NEAREST, block=64)
    return odd.select("id", "workspace_id").join(near, "id", "left_anti")


def hybrid_search(spark, sf):
    hits = search.hybrid(fx.vector_notes(spark, sf), _query(spark, sf), N,
                         search.Scope(workspace="agent2"), fx.now())
    return search.floor(hits, FLOOR).select("id", _r("distance"), _r("score"), "source")


def hybrid_scoped_peer(spark, sf):
    """Scope and peer hide rows from both legs."""
    n = F.floor(F.col("doc_id") / 6)
    rows = fx.vector_notes(spark, sf).withColumns({
        "scope": F.when(n % 2 == 0, "in").otherwise("out"), "peer_id": F.concat(F.lit("p"), (n % 3).cast("string"))})
    hits = search.hybrid(rows, _query(spark, sf), N, search.Scope(workspace="agent2", scope="in", peer="p1"), fx.now())
    return hits.select("id", _r("distance"), _r("score"), "source")


def hybrid_unscoped(spark, sf):
    hits = search.hybrid(fx.vector_notes(spark, sf), _query(spark, sf), N, search.Scope(), fx.now())
    return hits.select("id", _r("distance"), _r("score"), "source")


def hybrid_fallback(spark, sf):
    hits = search.hybrid(fx.vector_notes(spark, sf), _query(spark, sf, "zzqqxx"), N,
                         search.Scope(workspace="agent2"), fx.now())
    return hits.select("id", _r("distance"), _r("score"), "source")


def search_all_workspaces(spark, sf):
    hits = search.search_all(fx.vector_notes(spark, sf), _query(spark, sf), N, fx.now(), FLOOR)
    return hits.select("id", "workspace_id", _r("score"), "source", "rank")


def search_all_semantic(spark, sf):
    hits = search.search_all(fx.vector_notes(spark, sf), _query(spark, sf), N, fx.now(), FLOOR,
                             use_hybrid=False)
    return hits.select("id", "workspace_id", _r("score"), "source", "rank")


def time_decay(spark, sf):
    hits = knn.with_distance(fx.vector_notes(spark, sf), fx.query_vector(spark, sf))
    return fusion.decay(hits, fx.now()).select("id", _r("distance"))


def relevance_floor(spark, sf):
    hits = knn.with_distance(fx.vectors(spark, sf), fx.query_vector(spark, sf))
    hits = hits.withColumn("score", score(F.col("distance")))
    per = hits.groupBy("workspace_id").agg(
        F.count_if(F.col("score") >= FLOOR).alias("relevant"),
        F.bool_or(F.col("score") >= FLOOR).alias("any_relevant"),
        F.round(F.coalesce(F.max("score"), F.lit(0.0)), 6).alias("best_score"))
    return per


def temporal_search(spark, sf):
    page = search.temporal(fx.vector_notes(spark, sf), _query(spark, sf), 5, 2,
                           search.Scope(workspace="agent3"), fx.now(),
                           "2026-01-01T00:00:00Z", "2026-02-20T00:00:00Z")
    return page.select("id", _r("distance"), F.col("total"), "place")


def grep_messages(spark, sf):
    rows = fx.messages(spark, sf).withColumnRenamed("message_id", "id")
    found = rows.where(predicates.contains_text(F.col("document"), "ENT"))
    return found.select("id", "workspace_id")


def grep_first(spark, sf):
    rows = fx.messages(spark, sf).withColumnRenamed("message_id", "id")
    return search.grep(rows, "The", 50, F.col("workspace_id") == "agent2").select("id", "session_id")


def _text_index(spark, rows):
    index = TextIndex(Tables(spark, f"{checkpoint_dir(spark).rstrip('/')}/recollect-texts-{uuid.uuid4().hex}"))
    index.add(rows.select("workspace_id", "id", "document"))
    return index


def grep_indexed(spark, sf):
    """`grep_messages` through the text index."""
    rows = fx.messages(spark, sf).withColumnRenamed("message_id", "id")
    return _text_index(spark, rows).grep(rows, "ENT").select("id", "workspace_id")


def grep_index_changed(spark, sf):
    """The index after a change: assistants' texts got an ending, system rows went."""
    rows = fx.messages(spark, sf).withColumnRenamed("message_id", "id").select("id", "workspace_id", "role", "document")
    index = _text_index(spark, rows)
    now = rows.where("role <> 'system'").withColumn("document", F.when(
        F.col("role") == "assistant", F.concat("document", F.lit(" Zyx"))).otherwise(F.col("document")))
    index.sync(now.select("workspace_id", "id", "document"))
    return index.grep(now, "zyx").unionByName(index.grep(now, "qu")).select("id", "workspace_id", "role")


def bm25_indexed(spark, sf):
    """`bm25_topk` through the text index."""
    rows = fx.notes(spark, sf).select("workspace_id", "id", "document")
    scored = _text_index(spark, rows).bm25(rows, query_terms(fx.QUERY_TEXT)).select("id", "bm25")
    return scored.orderBy(F.col("bm25").desc(), "id").limit(20).select("id", _r("bm25"))


def recall_by_search(spark, sf):
    """Every twentieth vector asks for the first letters of its note, odd ones in a workspace that is not theirs."""
    rows = fx.vector_notes(spark, sf)
    asked = rows.where("doc_id % 20 < 2 and embedding is not null").select(
        F.col("id").alias("q"), F.when(F.col("doc_id") % 2 == 1, "agent3").otherwise(F.col("workspace_id")).alias("workspace_id"), "embedding",
        F.left("document", F.lit(2)).alias("expected"))
    return search.recall(rows, asked, 3, fx.now(), FLOOR).select("queries", "found", _r("recall"))


def ask_context(spark, sf):
    hits = search.semantic(fx.vector_notes(spark, sf), _query(spark, sf), 5,
                           search.Scope(workspace="agent2"), fx.now())
    return search.context_text(hits, FLOOR).select(F.sha2("context", 256).alias("digest"))


def ne_keeps_null(spark, sf):
    peer = F.when(F.col("doc_id") % 3 == 0, "codeindex").when(F.col("doc_id") % 3 == 1, "peer")
    rows = fx.notes(spark, sf).withColumn("peer_id", peer)
    return rows.where(predicates.differs(F.col("peer_id"), "codeindex")).groupBy(
        "workspace_id").agg(F.count(F.lit(1)).alias("kept"), F.count("peer_id").alias("with_peer"))


def first_seen_dedup(spark, sf):
    rows = fx.notes(spark, sf).select(F.sha2("document", 256).alias("digest"), "doc_id", "id")
    return skew.first_seen(rows, ["digest"], [F.col("doc_id")]).select("digest", "id")


def paging(spark, sf):
    rows = fx.messages(spark, sf).select("message_id", "created_at")
    return skew.page(rows, [F.col("created_at"), F.col("message_id")], 20, 40).select("message_id")


def paging_deep(spark, sf):
    """The same page by distributed ranks, as deep pages are read."""
    rows = fx.messages(spark, sf).select("message_id", "created_at")
    return skew.page(rows, [F.col("created_at"), F.col("message_id")], 20, 40, shallow=0).select("message_id")


def batches_of_ten(spark, sf):
    """The batch every message falls into."""
    rows = fx.messages(spark, sf).select("message_id")
    placed = skew.running(rows, [], [F.col("message_id")], rank="place")
    return placed.select("message_id", F.floor((F.col("place") - 1) / 10).alias("batch"))


# --- the same in SQL --------------------------------------------------------------------------

_TOKENS = ["the", "ertion", "src1_en", "src1", "en", "doc3"]
_NAMES = ["the", "ertion", "src1_en", "src1", "doc3"]
_WORDS = r"length(regexp_extract_all({low}, '[^\s\x0B\x85\p{{Z}}]+'))"


def _list(items):
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DIST = f"1 - list_cosine_similarity(embedding::DOUBLE[], {_QV})"
_HOURS = "((epoch_us(TIMESTAMP '2026-03-01 00:00:00') - epoch_us(created_at)) / 3.6e9)"
_DECAY = (f"CASE WHEN role <> 'system' AND importance < 4 AND {_HOURS} > 168 "
          f"THEN distance / exp(-0.01 * ({_HOURS} - 168) / 24) ELSE distance END")
_DECAYED_FUSED = _DECAY.replace("distance", "(1 - fused)")


def _rerank_sql(tokens, names, low, high):
    tags = "array_to_string(tags, ',')"
    everything = f"lower(document || ' ' || header_path || ' ' || {tags})"
    lexical_sum = (
        f"list_sum(list_transform({_list(tokens)}, lambda t: ln(1.0"
        f" + (length({everything}) - length(replace({everything}, t, ''))) / length(t)"
        f" + contains(lower(header_path), t)::INT + contains(lower({tags}), t)::INT)))")
    share = lambda c: (
        f"len(list_filter({c}, lambda x: list_contains({_list(names)}::VARCHAR[], lower(trim(x))))) "
        f"/ len({c})::DOUBLE")
    return (f"0.55 * (1 - (distance - {low}) / CASE WHEN {high} - {low} < 0.01 THEN 0.5 "
            f"ELSE {high} - {low} END)"
            f" + 0.25 * least(1.0, {lexical_sum} / 3.0) + 0.08 * (importance - 1) / 4.0"
            f" + 0.07 * CASE WHEN {share('entities')} > 0 THEN least(1.0, 0.5 + 0.5 * {share('entities')})"
            f" ELSE 0.5 * {share('tags')} END + 0.05 * 0.5")


def _bm25_sql(corpus, tokens, key=None, out="lexed"):
    """CTEs that end in `out`(key, id, bm25)."""
    k = f"{key}, " if key else ""
    tf = [f"(length(low) - length(replace(low, '{t}', ''))) / {len(t)}" for t in tokens]
    tfs = ", ".join(f"{e} AS tf{i}" for i, e in enumerate(tf))
    dfs = ", ".join(f"(count(*) FILTER (tf{i} > 0))::DOUBLE AS df{i}" for i in range(len(tokens)))
    parts = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2"
        f" / (tf{i} + 1.2 * (0.25 + 0.75 * len / al)) ELSE 0 END" for i in range(len(tokens)))
    group = f"GROUP BY {key}" if key else ""
    join = f"JOIN {out}_stats USING ({key})" if key else f"CROSS JOIN {out}_stats"
    words = _WORDS.format(low="low")
    return f"""
{out}_low AS (SELECT {k}id, lower(document) AS low FROM {corpus}),
{out}_tf AS (SELECT {k}id, {words}::DOUBLE AS len, {tfs} FROM {out}_low),
{out}_stats AS (SELECT {k}count(*)::DOUBLE AS n, avg(len) AS al, {dfs} FROM {out}_tf {group}),
{out} AS (SELECT * FROM (SELECT {k}id, {parts} AS bm25 FROM {out}_tf {join}) WHERE bm25 > 0)"""


def _semantic_sql(where, n, tokens=_TOKENS, names=_NAMES):
    """CTEs that end in `sem` with rank, distance and score."""
    return fx.VECTOR_NOTES_SQL + f""",
hit0 AS (SELECT * EXCLUDE (embedding), {_DIST} AS distance FROM vnote
         WHERE embedding IS NOT NULL AND ({where}) ORDER BY distance, id LIMIT {n}),
hit1 AS (SELECT * REPLACE ({_DECAY} AS distance) FROM hit0),
hit2 AS (SELECT *, min(distance) OVER () AS lo, max(distance) OVER () AS hi FROM hit1),
hit3 AS (SELECT *, {_rerank_sql(tokens, names, 'lo', 'hi')} AS rerank FROM hit2),
sem AS (SELECT *, greatest(0, 1 - distance) AS score,
               row_number() OVER (ORDER BY rerank DESC, distance, id) - 1 AS rank FROM hit3)"""


def _hybrid_sql(where, lexical_where, tokens=_TOKENS, names=_NAMES):
    return f"""
WITH {_semantic_sql(where, 2 * N, tokens, names)},
corpus AS (SELECT * FROM vnote WHERE {lexical_where}),{_bm25_sql('corpus', tokens)},
lex AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rank
        FROM (SELECT * FROM lexed ORDER BY bm25 DESC, id LIMIT {N})),
fused AS (SELECT id, least(1, sum(1.0 / (60 + rank)) / (2.0 / 60)) AS fused
          FROM (SELECT id, rank FROM sem UNION ALL SELECT id, rank FROM lex) GROUP BY id
          ORDER BY fused DESC, id LIMIT {N}),
done AS (SELECT id, {_DECAYED_FUSED} AS distance, 'hybrid' AS source
         FROM fused JOIN note USING (id) WHERE EXISTS (SELECT 1 FROM lex)
         UNION ALL
         SELECT id, distance, 'semantic-fallback' FROM sem
         WHERE NOT EXISTS (SELECT 1 FROM lex) AND rank < {N})
SELECT id, round(distance, 6) AS distance, round(greatest(0, 1 - distance), 6) AS score, source
FROM done"""


_SCOPED2 = "workspace_id IN ('agent2', '_global')"
_HIDDEN = "doc_id // 6 % 2 = 0 AND doc_id // 6 % 3 = 1"
_OPEN = "lower(trim(workspace_id)) <> 'finance'"


def _search_all_sql(hybrid):
    m = 2 * N
    deep = 2 * m if hybrid else m
    head = f"""
WITH {fx.VECTOR_NOTES_SQL},
own AS (SELECT * EXCLUDE (embedding), {_DIST} AS distance FROM vnote
        WHERE embedding IS NOT NULL AND {_OPEN}
        QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY distance, id) <= {deep}),
spaces AS (SELECT DISTINCT workspace_id AS list FROM vnote
           WHERE {_OPEN} AND workspace_id <> '_global'),
lists AS (SELECT workspace_id AS list, * FROM own
          UNION ALL SELECT spaces.list, own.* FROM spaces, own WHERE own.workspace_id = '_global'),
l0 AS (SELECT * FROM lists
       QUALIFY row_number() OVER (PARTITION BY list ORDER BY distance, id) <= {deep}),
l1 AS (SELECT * REPLACE ({_DECAY} AS distance) FROM l0),
l2 AS (SELECT *, min(distance) OVER (PARTITION BY list) AS lo,
              max(distance) OVER (PARTITION BY list) AS hi FROM l1),
l3 AS (SELECT *, {_rerank_sql(_TOKENS, _NAMES, 'lo', 'hi')} AS rerank FROM l2),
vecs AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY rerank DESC, distance, id) - 1
                AS rank FROM l3)"""
    if hybrid:
        body = f""",
open_note AS (SELECT * FROM note WHERE {_OPEN}),{_bm25_sql('open_note', _TOKENS, 'workspace_id')},
lex AS (SELECT workspace_id AS list, id,
               row_number() OVER (PARTITION BY workspace_id ORDER BY bm25 DESC, id) - 1 AS rank
        FROM lexed QUALIFY rank < {m}),
fused AS (SELECT list, id, least(1, sum(1.0 / (60 + rank)) / (2.0 / 60)) AS fused
          FROM (SELECT list, id, rank FROM vecs UNION ALL SELECT list, id, rank FROM lex)
          GROUP BY list, id
          QUALIFY row_number() OVER (PARTITION BY list ORDER BY fused DESC, id) <= {m}),
done AS (SELECT list, id, greatest(0, 1 - {_DECAYED_FUSED}) AS score, 'hybrid' AS source
         FROM fused JOIN note USING (id)
         UNION ALL
         SELECT list, id, greatest(0, 1 - distance), 'semantic-fallback' FROM vecs
         WHERE rank < {m} AND list NOT IN (SELECT list FROM lex))"""
    else:
        body = """,
done AS (SELECT list, id, greatest(0, 1 - distance) AS score, 'semantic' AS source FROM vecs)"""
    return head + body + f""",
best AS (SELECT * FROM done WHERE score >= {FLOOR}
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, list) = 1),
top AS (SELECT * FROM best ORDER BY score DESC, id LIMIT {N})
SELECT id, list AS workspace_id, round(score, 6) AS score, source,
       row_number() OVER (ORDER BY top.score DESC, id) - 1 AS rank FROM top"""


def _knn_sql(where):
    return f"""WITH {fx.VECTORS_SQL}
SELECT id, workspace_id, round(d, 6) AS distance
FROM (SELECT id, workspace_id, {_DIST} AS d FROM vec WHERE {where} ORDER BY d, id LIMIT {N})"""


ORACLE = {
    "knn_topk": _knn_sql("true"),
    "knn_scoped": _knn_sql("workspace_id IN ('ws3', '_global')"),
    "knn_excluded": _knn_sql(_OPEN),
    "knn_indexed": f"""WITH {fx.VECTORS_SQL}
SELECT q.id AS q, v.id, v.workspace_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance
FROM vec q, vec v WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY 1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.id) <= {N}""",
    "knn_index_recall": "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0",
    "conclusion_search": f"""WITH {fx.VECTORS_SQL},
top AS (SELECT id, workspace_id, {_DIST} AS d FROM vec WHERE workspace_id IN ('ws2', '_global')
        ORDER BY d, id LIMIT {N})
SELECT id, workspace_id, round(d, 6) AS distance, round(greatest(0, 1 - d), 6) AS score,
       row_number() OVER (ORDER BY d, id) - 1 AS rank FROM top""",
    "vector_scores": f"""WITH {fx.VECTORS_SQL}
SELECT id, round({_DIST}, 6) AS distance, round(greatest(0, 1 - ({_DIST})), 6) AS score FROM vec""",
    "bm25_topk": f"""WITH {fx.NOTES_SQL},{_bm25_sql('note', _TOKENS)}
SELECT id, round(lexed.bm25, 6) AS bm25 FROM lexed ORDER BY lexed.bm25 DESC, id LIMIT 20""",
    "bm25_scores": f"""WITH {fx.NOTES_SQL},{_bm25_sql('note', _TOKENS, 'workspace_id')}
SELECT id, workspace_id, round(lexed.bm25, 6) AS bm25 FROM lexed""",
    "bm25_df": "SELECT term, count(*) FILTER (contains(lower(text), term)) AS df FROM documents, "
               f"(SELECT unnest({_list(_TOKENS)}) AS term) GROUP BY term",
    "bm25_corpus_stats": f"""WITH {fx.NOTES_SQL}
SELECT workspace_id, count(*) AS docs, round(avg({_WORDS.format(low='lower(document)')}), 6) AS average
FROM note GROUP BY 1""",
    "rrf_fusion": f"""WITH {fx.VECTOR_NOTES_SQL},{_bm25_sql('note', _TOKENS)},
v AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM
      (SELECT id, {_DIST} AS d FROM vnote WHERE embedding IS NOT NULL ORDER BY d, id LIMIT {2 * N})),
l AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rank FROM
      (SELECT id, bm25 FROM lexed ORDER BY bm25 DESC, id LIMIT {2 * N}))
SELECT id, round(least(1, sum(1.0 / (60 + rank)) / (2.0 / 60)), 6) AS fused
FROM (SELECT * FROM v UNION ALL SELECT * FROM l) GROUP BY id""",
    "semantic_search": f"""WITH {_semantic_sql(_SCOPED2, 2 * N)}
SELECT id, workspace_id, round(distance, 6) AS distance, round(score, 6) AS score, rank,
       'reranked' AS source FROM sem""",
    "workflow_rerank": f"""WITH {fx.VECTOR_NOTES_SQL},
d AS (SELECT *, {_DIST} AS distance FROM vnote WHERE embedding IS NOT NULL),
s AS (SELECT *, min(distance) OVER (PARTITION BY workspace_id) AS lo,
             max(distance) OVER (PARTITION BY workspace_id) AS hi FROM d)
SELECT id, round({_rerank_sql(_TOKENS, _NAMES, 'lo', 'hi')}, 6) AS rerank FROM s""",
    "dream_candidates": f"""WITH {fx.VECTORS_SQL}
SELECT id, workspace_id FROM vec a WHERE vec_id % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM vec b WHERE b.vec_id % 2 = 0 AND a.workspace_id = b.workspace_id
  AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 1 - {DREAM_NEAREST})""",
    "hybrid_search": _hybrid_sql(_SCOPED2, "workspace_id = 'agent2'").replace(
        "FROM done", f"FROM done WHERE greatest(0, 1 - distance) >= {FLOOR}"),
    "hybrid_scoped_peer": _hybrid_sql(
        f"{_SCOPED2} AND {_HIDDEN}", f"workspace_id = 'agent2' AND {_HIDDEN}"),
    "hybrid_unscoped": _hybrid_sql(
        _OPEN, "workspace_id = (SELECT workspace_id FROM sem WHERE rank = 0)"),
    "hybrid_fallback": _hybrid_sql(_SCOPED2, "workspace_id = 'agent2'", ["zzqqxx"], ["zzqqxx"]),
    "search_all_workspaces": _search_all_sql(True),
    "search_all_semantic": _search_all_sql(False),
    "time_decay": f"""WITH {fx.VECTOR_NOTES_SQL},
d AS (SELECT *, {_DIST} AS distance FROM vnote WHERE embedding IS NOT NULL)
SELECT id, round({_DECAY}, 6) AS distance FROM d""",
    "relevance_floor": f"""WITH {fx.VECTORS_SQL},
s AS (SELECT workspace_id, greatest(0, {_DIST}) AS dist, greatest(0, 1 - ({_DIST})) AS score FROM vec)
SELECT workspace_id, count(*) FILTER (score >= {FLOOR}) AS relevant,
       bool_or(score >= {FLOOR}) AS any_relevant, round(max(score), 6) AS best_score
FROM s GROUP BY 1""",
    "temporal_search": f"""WITH {_semantic_sql("workspace_id IN ('agent3', '_global')", 7)},
kept AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY rank) AS place FROM sem
         WHERE created_at BETWEEN TIMESTAMP '2026-01-01' AND TIMESTAMP '2026-02-20')
SELECT id, round(distance, 6) AS distance, total, place FROM kept WHERE place BETWEEN 3 AND 7""",
    "grep_messages": f"""WITH {fx.MESSAGES_SQL}
SELECT message_id AS id, workspace_id FROM msg WHERE contains(lower(document), 'ent')""",
    "grep_first": f"""WITH {fx.MESSAGES_SQL}
SELECT message_id AS id, session_id FROM msg
WHERE workspace_id = 'agent2' AND contains(lower(document), 'the') ORDER BY 1 LIMIT 50""",
    "grep_indexed": f"""WITH {fx.MESSAGES_SQL}
SELECT message_id AS id, workspace_id FROM msg WHERE contains(lower(document), 'ent')""",
    "grep_index_changed": f"""WITH {fx.MESSAGES_SQL},
now AS (SELECT message_id AS id, workspace_id, role, document || CASE role WHEN 'assistant' THEN ' Zyx' ELSE '' END AS document
        FROM msg WHERE role <> 'system')
SELECT id, workspace_id, role FROM now WHERE contains(lower(document), 'zyx')
UNION ALL SELECT id, workspace_id, role FROM now WHERE contains(lower(document), 'qu')""",
    "bm25_indexed": f"""WITH {fx.NOTES_SQL},{_bm25_sql('note', _TOKENS)}
SELECT id, round(lexed.bm25, 6) AS bm25 FROM lexed ORDER BY lexed.bm25 DESC, id LIMIT 20""",
    "recall_by_search": f"""WITH {fx.VECTOR_NOTES_SQL},
asked AS (SELECT id AS q, CASE WHEN doc_id % 2 = 1 THEN 'agent3' ELSE workspace_id END AS space, embedding AS e, left(document, 2) AS expected
          FROM vnote WHERE doc_id % 20 < 2 AND embedding IS NOT NULL),
near AS (SELECT q, expected, v.*, 1 - list_cosine_similarity(v.embedding::DOUBLE[], e::DOUBLE[]) AS distance
         FROM asked JOIN vnote v ON v.workspace_id IN (space, '_global') AND v.embedding IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, v.workspace_id, v.id) <= 3),
found AS (SELECT DISTINCT q FROM near WHERE contains(lower(document), lower(expected)) AND greatest(0, 1 - ({_DECAY})) >= {FLOOR})
SELECT count(*) AS queries, count(found.q) AS found, round(count(found.q) / count(*), 6) AS recall FROM asked LEFT JOIN found USING (q)""",
    "ask_context": f"""WITH {_semantic_sql(_SCOPED2, 5)}
SELECT sha256(string_agg(document, chr(10) ORDER BY rank)) AS digest FROM sem WHERE score >= {FLOOR}""",
    "ne_keeps_null": f"""WITH {fx.NOTES_SQL},
p AS (SELECT workspace_id, CASE doc_id % 3 WHEN 0 THEN 'codeindex' WHEN 1 THEN 'peer' END AS peer_id
      FROM note)
SELECT workspace_id, count(*) AS kept, count(peer_id) AS with_peer FROM p
WHERE peer_id IS DISTINCT FROM 'codeindex' GROUP BY 1""",
    "first_seen_dedup": """SELECT sha256(text) AS digest, 'd' || min(doc_id) AS id
FROM documents GROUP BY 1""",
    "paging": f"""WITH {fx.MESSAGES_SQL}
SELECT message_id FROM msg ORDER BY created_at, message_id LIMIT 20 OFFSET 40""",
    "paging_deep": f"""WITH {fx.MESSAGES_SQL}
SELECT message_id FROM msg ORDER BY created_at, message_id LIMIT 20 OFFSET 40""",
    "batches_of_ten": f"""WITH {fx.MESSAGES_SQL}
SELECT message_id, (row_number() OVER (ORDER BY message_id) - 1) // 10 AS batch FROM msg""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
