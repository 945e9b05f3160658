"""M1-M8: the composite searches, as DataFrame plans over the chunk table.

Every leg scans its table once. Hit lists are bounded by the requested number of results, so
they are written to the checkpoint folder and reused instead of being computed per use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.identifiers import lex_tokens, query_terms
from recollect.functions.vectors import cosine_distance, score
from recollect.operators.fusion import decay, lexical_feature, rerank, rrf
from recollect.operators.knn import nearest, top_matches
from recollect.operators.lexical import bm25_counted, term_frequencies
from recollect.operators.predicates import (differs, equals, is_edge, not_excluded,
                                            role_or_unknown, visible, within)
from recollect.operators.skew import first_seen, join_lookup, rank_bounded, top_per_key
from recollect.session import cut_lineage, hold
from recollect.settings import SHARED_WORKSPACE

METADATA = ["workspace_id", "session_id", "role", "created_at", "importance", "header_path",
            "tags", "entities"]
HIT = ["id", "document", *METADATA]


@dataclass(frozen=True)
class Query:
    """A query as both legs need it. `text` is split into tokens on the driver."""

    text: str
    vector: list[float]

    @property
    def tokens(self) -> list[str]:
        return lex_tokens(self.text)

    @property
    def terms(self) -> list[str]:
        return query_terms(self.text)


@dataclass(frozen=True)
class Scope:
    workspace: str = ""
    session: str = ""
    role: str = ""
    scope: str = ""
    peer: str = ""
    excluded: tuple[str, ...] = ("finance",)

    def rows(self) -> Column:
        return visible(self.workspace, self.session, self.role, self.scope, self.peer,
                       self.excluded)


def wanted(n: int | None, default: int = 10) -> int:
    """the number of results asked for; a larger request is honoured, not cut."""
    return n if n and n > 0 else default


def content_rows(rows: DataFrame) -> DataFrame:
    """The rows that are content."""
    kind = F.col("chunk_type") if "chunk_type" in rows.columns else F.lit(None).cast("string")
    return rows.where(~is_edge(F.col("id"), kind))


def semantic(rows: DataFrame, query: Query, n: int, scope: Scope, now: Column,
             reorder: bool = True) -> DataFrame:
    """M1: nearest rows, decayed, scored and reordered; `rank` gives the order."""
    hits = nearest(content_rows(rows).where(scope.rows()).select(*HIT, *_vector(rows)),
                   query.vector, n).drop("rank")
    hits = _scored(hits, now)
    if reorder:
        return _reordered(hits, query)
    order = Window.partitionBy(F.lit(0)).orderBy("distance", "id")
    return hits.withColumns({"rerank": F.lit(None).cast("double"), "source": F.lit("semantic"),
                             "rank": F.row_number().over(order) - 1})


def _scored(hits: DataFrame, now: Column) -> DataFrame:
    return decay(hits, now).withColumn("score", score(F.col("distance")))


def _reordered(hits: DataFrame, query: Query, lexical: Column | None = None) -> DataFrame:
    several = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > 1
    return rerank(hits, query.tokens, lexical=lexical).withColumn("source", F.when(several, "reranked").otherwise("semantic"))


def _by_people(rows: DataFrame) -> Column:
    """The text leg leaves out what the code index wrote."""
    return differs(F.col("peer_id"), "codeindex") if "peer_id" in rows.columns else F.lit(True)


def _vector(rows: DataFrame) -> list[str]:
    return ["embedding", *(["norm"] if "norm" in rows.columns else [])]


def _fused(vec: DataFrame, lex: DataFrame, keys: list[str], n: int, now: Column, group: list[str] | None = None) -> DataFrame:
    """Fused hits with their metadata, the best `n` of each `group`; all inputs are bounded hit lists."""
    fused = rrf([vec, lex], keys)
    order = [F.col("fused").desc(), F.col("id"), F.col("workspace_id")]
    top = (top_per_key(fused, group, order, n) if group else rank_bounded(fused, order, n)).drop("rank")
    body = list(dict.fromkeys([*keys, "id", *METADATA]))
    details = first_seen(vec.select(*body).unionByName(lex.select(*body)), keys, [F.lit(0)])
    hits = top.join(details, keys).withColumn("distance", 1 - F.col("fused")).drop("fused")
    return decay(hits, now).withColumn("score", score(F.col("distance"))).withColumn(
        "source", F.lit("hybrid"))


def of_keys(rows: DataFrame, keys: list, columns: list[str]) -> DataFrame:
    """Columns of a bounded list of rows, by workspace and id: both become filters that reach the scan and prune folders."""
    found = rows.where(F.col("workspace_id").isin(sorted({k[0] for k in keys})) & F.col("id").isin(sorted({k[1] for k in keys})))
    return found.select(*columns)


def with_documents(hits: DataFrame, rows: DataFrame, n: int, home: str = "workspace_id") -> DataFrame:
    """The texts of a final hit list of at most `n` rows; their workspace is column `home` of the hits."""
    hits = hold(hits, n)
    texts = of_keys(rows, hits.select(home, "id").collect(), ["workspace_id", "id", "document"])
    return hits.join(F.broadcast(texts.withColumnRenamed("workspace_id", home)), [home, "id"], "left")


def _measured(rows: DataFrame, query: Query, terms: list[str], near: Column | None = None, **marks: Column) -> DataFrame:
    """Distance, wording and term counts of every row, in one scan: a narrow table without texts, vectors or
    metadata. Rows outside `near` or without a vector of the query's width have no distance; `marks` are kept as columns."""
    stored = "norm" if "norm" in rows.columns else None
    fits = F.size("embedding") == len(query.vector)
    distance = F.when(fits if near is None else near & fits, cosine_distance("embedding", query.vector, stored))
    seen = rows.select("workspace_id", "id", distance.alias("distance"), lexical_feature(query.tokens).alias("wording"),
                       *[c.alias(name) for name, c in marks.items()], "document")
    return cut_lineage(term_frequencies(seen, terms))


def hybrid(rows: DataFrame, query: Query, n: int, scope: Scope, now: Column) -> DataFrame:
    """M2: both legs fused; what scope, peer, session and role hide is hidden from both. Without lexical
    hits the vector hits are returned as they are, labelled `semantic-fallback`. An unscoped search takes its
    texts from the workspace of the best vector hit."""
    content = content_rows(rows)
    seen = F.coalesce(scope.rows(), F.lit(False))
    told = F.coalesce(equals(workspace_id=scope.workspace, session_id=scope.session, scope=scope.scope, peer_id=scope.peer)
                      & role_or_unknown(scope.role), F.lit(False)) & _by_people(rows)
    measured = _measured(content.where(seen | told), query, query.terms, seen, told=told)
    row = ["workspace_id", "id"]
    near = rank_bounded(measured.where("distance IS NOT NULL").select(*row, "distance", "wording"),
                        [F.col("distance"), F.col("id")], 2 * n)
    keys = near.orderBy("rank").select(*row).collect()
    leg = lambda facts: _reordered(_scored(near.drop("rank").join(facts, row), now), query, F.col("wording"))
    workspace = scope.workspace
    if not workspace:
        # the best one as the hits are handed out, which need not be the nearest
        best = leg(of_keys(content, keys, [c for c in HIT if c != "document"])).where("rank = 0").select("workspace_id").first()
        workspace = best[0] if best else None
    corpus = measured.where(F.col("told") & (F.col("workspace_id") == workspace)).drop("told", "distance", "wording")
    scored = (bm25_counted(corpus, query.terms, ["workspace_id"]) if query.terms
              else corpus.withColumn("bm25", F.lit(0.0)).limit(0))
    lex = rank_bounded(scored.select(*row, "bm25"), [F.col("bm25").desc(), F.col("id")], n)
    # at most 3n rows: both legs are numbers up to here
    known = cut_lineage(of_keys(content, keys + lex.select(*row).collect(), HIT))
    facts = known.drop("document")
    vec = leg(facts)
    lex = lex.join(facts, row)
    none = lex.select((F.count(F.lit(1)) == 0).alias("none")).scalar()
    columns = ["id", *METADATA, "distance", "score", "source"]
    fallback = (vec.where(none).where(F.col("rank") < n)
                .withColumn("source", F.lit("semantic-fallback")))
    fused = _fused(vec, lex, ["workspace_id", "id"], n, now).where(~none)
    order = Window.partitionBy(F.lit(0)).orderBy("distance", "id")
    fused = fused.withColumn("rank", F.row_number().over(order) - 1)
    hits = fused.select(*columns, "rank").unionByName(fallback.select(*columns, "rank"))
    return hits.join(F.broadcast(known.select(*row, "document")), row, "left")


def floor(hits: DataFrame, minimum: float) -> DataFrame:
    """Hits without a score are dropped too."""
    return hits.where(F.col("score") >= minimum)


def best_score(hits: DataFrame) -> DataFrame:
    """The greatest score, 0 without hits."""
    return hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best_score"))


def search_all(rows: DataFrame, query: Query, n: int, now: Column, min_score: float,
               excluded: tuple[str, ...] = ("finance",), use_hybrid: bool = True) -> DataFrame:
    """M3: the same search in every workspace at once, then the best of all.

    Workspaces are a key, not a loop: ranks, corpus numbers and fusion are kept per workspace,
    and each task keeps only its best rows of a workspace before the shuffle. Texts and vectors are read in
    one scan, which keeps numbers only; metadata is looked up for the candidates of both legs. Rows of the
    shared workspace join every list through one array of bounded length.
    """
    m = 2 * n
    deep = 2 * m if use_hybrid else m
    open_rows = content_rows(rows).where(not_excluded(F.col("workspace_id"), excluded))
    order = [F.col("distance"), F.col("id")]
    mixed = [*order, F.col("home")]
    row = ["workspace_id", "id"]
    terms = query.terms if use_hybrid else []
    measured = _measured(open_rows, query, terms)
    near = cut_lineage(top_per_key(measured.where("distance IS NOT NULL").select(*row, "distance", "wording"),
                                   ["workspace_id"], order, deep).drop("rank"))
    picked = near.select(*row)
    if terms:
        lex = cut_lineage(top_per_key(bm25_counted(measured.drop("distance", "wording"), terms, ["workspace_id"]),
                                      ["workspace_id"], [F.col("bm25").desc(), F.col("id")], m))
        picked = picked.union(lex.select(*row)).distinct()
    # the candidates are few: what is known of them is looked up, the rest of the table stays where it is
    known = cut_lineage(join_lookup(open_rows.select("id", *METADATA), picked, row, "inner"))
    own = near.join(known, row).withColumn("home", F.col("workspace_id"))
    body = [c for c in own.columns if c != "workspace_id"]
    # at most `deep` rows: the shared workspace's own best
    shared = own.where(F.col("workspace_id") == SHARED_WORKSPACE).agg(
        F.collect_list(F.struct(*body)).alias("rows")).scalar()
    lists = (measured.where(F.col("workspace_id") != SHARED_WORKSPACE).select("workspace_id").distinct()
             .select("workspace_id", F.explode(shared).alias("hit"))
             .select("workspace_id", "hit.*"))
    vec = top_per_key(own.unionByName(lists), ["workspace_id"], mixed, deep).drop("rank")
    vec = decay(vec, now).withColumn("score", score(F.col("distance")))
    vec = rerank(vec, query.tokens, ["workspace_id"], lexical=F.col("wording"))
    columns = ["workspace_id", "home", "id", "score", "source"]
    if terms:
        vec = cut_lineage(vec)
        lex = cut_lineage(lex.join(known, row).withColumn("home", F.col("workspace_id")))
        fused = _fused(vec, lex, ["workspace_id", "home", "id"], m, now, ["workspace_id"])
        alone = vec.where(F.col("rank") < m).join(
            lex.select("workspace_id").distinct(), "workspace_id", "left_anti").withColumn(
                "source", F.lit("semantic-fallback"))
        hits = fused.select(*columns).unionByName(alone.select(*columns))
    else:
        only = "semantic-fallback" if use_hybrid else "semantic"
        hits = vec.where(F.col("rank") < m).withColumn("source", F.lit(only)).select(*columns)
    # a row of the shared workspace may be on every list: it counts once, where it does best
    best = first_seen(floor(hits, min_score), ["home", "id"], [-F.col("score"), F.col("workspace_id")])
    top = rank_bounded(best, [F.col("score").desc(), F.col("id"), F.col("home")], n)
    return with_documents(top, open_rows, n, "home").drop("home")


def temporal(rows: DataFrame, query: Query, n: int, offset: int, scope: Scope, now: Column,
             after: str | None = None, before: str | None = None) -> DataFrame:
    """The time bounds apply to the hits of the search, as pages of it do; `total` is
    the number of hits within the bounds."""
    hits = semantic(rows, query, n + offset, scope, now).where(within(F.col("created_at"), after, before))
    whole = Window.partitionBy(F.lit(0))
    placed = (hits.withColumn("total", F.count(F.lit(1)).over(whole))
              .withColumn("place", F.row_number().over(whole.orderBy("rank"))))
    return placed.where(F.col("place").between(offset + 1, offset + n))


def grep(rows: DataFrame, needle: str, limit: int, where: Column) -> DataFrame:
    """M6: substring search, whole table, in id order."""
    found = rows.where(where & F.contains(F.lower(F.col("document")), F.lit(needle.lower())))
    return found.orderBy("id").limit(limit)


def conclusions(rows: DataFrame, vector: list[float], n: int, workspace: str) -> DataFrame:
    """Nearest conclusions of a workspace and of the shared one."""
    seen = (F.col("workspace_id").isin(workspace, SHARED_WORKSPACE) if workspace else F.lit(False))
    return nearest(rows, vector, n, seen).withColumn("score", score(F.col("distance")))


def recall(rows: DataFrame, asked: DataFrame, n: int, now: Column, min_score: float) -> DataFrame:
    """Queries, found and recall of many searches at once. `asked` are (q, workspace_id, embedding, expected); a query is found if
    one of the `n` nearest rows of its workspace and the shared one passes the floor and holds the expected text in any case.

    Queries and rows of a workspace meet in blocks; keys and distances alone are handed on, and texts are joined to the hits."""
    rows = content_rows(rows)
    spaces = F.array_distinct(F.array(F.col("workspace_id"), F.lit(SHARED_WORKSPACE)))
    each = asked.select("q", "embedding", F.explode(spaces).alias("workspace_id"))
    hits = top_matches(each, rows.select(F.struct("workspace_id", "id").alias("id"), "workspace_id", "embedding"), ["q"], n)
    hits = cut_lineage(hits.select("q", "id.*", "distance"))
    keys = hits.select("workspace_id", "id").distinct()
    texts = join_lookup(rows.select("workspace_id", "id", "role", "importance", "created_at", "document"), keys, ["workspace_id", "id"], "left_semi")
    scored = decay(hits.join(texts, ["workspace_id", "id"]), now).withColumn("score", score(F.col("distance")))
    holds = F.contains(F.lower("document"), F.lower("expected"))
    found = floor(scored, min_score).join(asked.select("q", "expected"), "q").where(holds).select("q").distinct().withColumn("found", F.lit(1))
    return asked.select("q").join(found, "q", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.count("found").alias("found"), F.coalesce(F.avg(F.coalesce("found", F.lit(0))), F.lit(0.0)).alias("recall"))


def context_text(hits: DataFrame, min_score: float) -> DataFrame:
    """M8: the texts of the hits above the floor, in rank order; null when there are none."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))),
                        lambda p: p["document"])
    return floor(hits, min_score).agg(
        F.when(F.count(F.lit(1)) > 0, F.concat_ws("\n", parts)).alias("context"))
