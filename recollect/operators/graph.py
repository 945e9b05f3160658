"""The file graph: building it from a vault and expanding neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.markdown import markdown_chunks
from recollect.functions.text import extract_entities, parent_doc_id, wikilinks
from recollect.operators.skew import first_seen, top_per_key
from recollect.session import cut_lineage

MIN_ENTITY_WEIGHT = 0.7


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Both directions of (from, to, relation, weight), of all nodes or those given (`node`); entities
    are entered only over heavy edges."""
    out = edges.select(F.col("from").alias("node"), F.col("to").alias("neighbour"),
                       F.lit(0).alias("direction"), "weight")
    back = edges.select(F.col("to").alias("node"), F.col("from").alias("neighbour"),
                        F.lit(1).alias("direction"), "weight")
    light = F.col("neighbour").startswith("entity:") & (F.col("weight") < MIN_ENTITY_WEIGHT)
    both = out.unionByName(back).where(~light)
    if nodes is not None:
        both = both.join(nodes, "node", "left_semi")
    return both.groupBy("node", "neighbour").agg(
        F.min("direction").alias("direction"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1, max_neighbours: int = 5,
           seeds_per_set: int = 1) -> DataFrame:
    """I4: per seed set (`seed`, `id`, `position`) the first `max_neighbours` nodes reached, in
    the order hop, parent, out before in, id.

    Only so many neighbours of a node can matter as are asked for plus those already visited,
    so each node keeps that many and a node with very many neighbours is never multiplied out.
    """
    keep = 2 * max_neighbours + seeds_per_set
    frontier = seeds.select("seed", "id", "position")
    visited = frontier.select("seed", "id")
    found = None
    for hop in range(1, hops + 1):
        # only the edges at the frontier are grouped and ranked
        at = cut_lineage(frontier.select(F.col("id").alias("node")).distinct())
        near = top_per_key(adjacency(edges, at), ["node"], [F.col("direction"), F.col("neighbour")], keep).drop("rank")
        reached = frontier.join(near, frontier["id"] == near["node"]).select(
            "seed", F.col("neighbour").alias("id"), F.lit(hop).alias("hop"),
            F.col("position").alias("parent"), "direction")
        fresh = first_seen(reached, ["seed", "id"], [F.col("parent"), F.col("direction")]).join(
            visited, ["seed", "id"], "left_anti")
        pool = fresh if found is None else found.drop("position").unionByName(fresh)
        order = [F.col("hop"), F.col("parent"), F.col("direction"), F.col("id")]
        found = cut_lineage(top_per_key(pool, ["seed"], order, max_neighbours, "position"))
        frontier = found.where(F.col("hop") == hop).select("seed", "id", "position")
        visited = visited.unionByName(frontier.select("seed", "id"))
    return found


def build(files: DataFrame, known_entities: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (from, to, relation, weight) of Markdown files
    (path, text). The shapes are the ones the graph reader takes."""
    docs = files.select(
        "path", "text", parent_doc_id(F.col("path")).alias("doc"),
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    chunks = cut_lineage(docs.select("path", "doc", F.posexplode(markdown_chunks(F.col("text"))))
                         .select("path", "doc", F.col("pos").alias("i"),
                                 extract_entities(F.col("col.body"), F.col("col.header_path"),
                                                  known_entities).alias("entities")))
    doc_id = F.concat(F.lit("doc:"), "doc")
    chunk_id = lambda i: F.concat(F.lit("chunk:"), "doc", F.lit(":"), i.cast("string"))
    folder_id = F.concat(F.lit("folder:"), "folder")
    mentions = chunks.select(chunk_id(F.col("i")).alias("chunk"), F.explode("entities").alias("entity"))
    entity_id = F.concat(F.lit("entity:"), F.lower("entity"))

    nodes = (
        docs.select(doc_id.alias("id"), F.lit("doc").alias("type"), F.col("path").alias("label"))
        .unionByName(docs.where("folder <> ''").select(
            folder_id.alias("id"), F.lit("folder").alias("type"), F.col("folder").alias("label")).distinct())
        .unionByName(chunks.select(chunk_id(F.col("i")).alias("id"), F.lit("chunk").alias("type"),
                                   F.concat("path", F.lit("#"), F.col("i").cast("string")).alias("label")))
        .unionByName(mentions.groupBy(entity_id.alias("id")).agg(F.min("entity").alias("label"))
                     .select("id", F.lit("entity").alias("type"), "label")))

    def edges(rows: DataFrame, a, b, relation: str) -> DataFrame:
        return rows.select(a.alias("from"), b.alias("to"), F.lit(relation).alias("relation"),
                           F.lit(1.0).alias("weight"))

    links = docs.select("doc", F.explode(wikilinks(F.col("text"))).alias("link"))
    previous = chunks.where("i > 0")
    return nodes, (
        edges(docs.where("folder <> ''"), doc_id, folder_id, "belongs_to")
        .unionByName(edges(chunks, chunk_id(F.col("i")), doc_id, "belongs_to"))
        .unionByName(edges(previous, chunk_id(F.col("i") - 1), chunk_id(F.col("i")), "next_chunk"))
        .unionByName(edges(mentions, F.col("chunk"), entity_id, "mentions"))
        .unionByName(edges(links, doc_id, F.concat(F.lit("doc:"), "link"), "links_to")))
