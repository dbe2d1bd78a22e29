"""Hybrid retrieval: rank fusion, diversity, neighbourhoods and budgeted context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Graph, node_id
from ..errors import SchemaError
from ..functions import text as bm
from ..functions import vectors
from . import embed, textindex
from .adjacency import Adjacency

RRF_K, LABEL_CAP, TOP_K, MAX_HOPS, TOKEN_BUDGET = 60, 2, 8, 3, 2000


def fuse(fts: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (``node_id``, ``label``, ``rank`` from 1).

    Gives ``node_id``, ``label``, ``score``, ``match``, ``fused_rank``. Ties keep the order of the text list, then of the vector list.
    """
    a = fts.select("node_id", "label", F.col("rank").alias("fts_rank"))
    b = vector.select("node_id", F.col("label").alias("vlabel"), F.col("rank").alias("vector_rank"))
    both = a.join(b, "node_id", "full_outer").withColumn("label", F.coalesce("label", "vlabel"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    text_first = F.col("fts_rank").isNotNull() & (F.col("vector_rank").isNull() | (F.col("fts_rank") <= F.col("vector_rank")))
    scored = both.select("node_id", "label", (part("fts_rank") + part("vector_rank")).alias("score"), F.when(text_first, "fts").otherwise("vector").alias("match"), "fts_rank", "vector_rank")
    order = Window.orderBy(F.desc("score"), F.col("fts_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "node_id")
    return scored.withColumn("fused_rank", F.row_number().over(order)).drop("fts_rank", "vector_rank")


def diversify(fused: DataFrame, top_k: int = TOP_K, cap: int = LABEL_CAP) -> DataFrame:
    """At most ``cap`` of a label first, in fused order; what is held back fills up. ``seed_rank`` is the order of the result."""
    if cap <= 0:
        return fused.withColumn("seed_rank", F.col("fused_rank")).where(F.col("seed_rank") <= top_k)
    within = F.row_number().over(Window.partitionBy("label").orderBy("fused_rank"))
    held = fused.withColumn("held", within > cap)
    picked = held.orderBy("held", "fused_rank").limit(top_k)
    return picked.withColumn("seed_rank", F.row_number().over(Window.orderBy("held", "fused_rank"))).drop("held")


def expand(graph: Graph, seeds: DataFrame, hops: int = 1, edges: DataFrame | None = None, held: list[DataFrame] | None = None, lists: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    """All nodes within ``hops`` of the seeds (``node_id``, ``depth``) and the edges met on the way, regardless of direction.

    Breadth first: each level joins the last level's new nodes only, so paths are never enumerated. The reached nodes are kept
    level by level, so that no level is worked out again; each relationship type is joined on its own keys, where files and their statistics can prune,
    and only types at which a label of the level's new nodes can stand are read. ``held`` gets the frames that are kept: unpersist them once the result is read.
    With ``lists`` a level reads the neighbour lists of its nodes instead.
    """
    held = [] if held is None else held
    hops = max(0, min(MAX_HOPS, hops))
    reached = seeds.select("node_id").distinct().withColumn("depth", F.lit(0))
    frontier, touched = reached, None
    types = None if edges is not None or lists else graph.visible_rels()
    for depth in range(1, hops + 1):
        frontier = frontier.persist()
        held.append(frontier)
        if lists:
            met = lists.edges_at(frontier)
        elif types is None:
            near = frontier.select(F.col("node_id").alias("near"))
            met = edges.join(near, edges["src"] == near["near"], "left_semi").union(edges.join(near, edges["dst"] == near["near"], "left_semi"))
        else:
            labels = {r["label"] for r in frontier.select(F.substring_index("node_id", ":", 1).alias("label")).distinct().collect()}  # labels of the graph
            met = _edges_at(graph, frontier, types, labels)
            if met is None:  # no relationship can stand there
                break
        met = met.distinct().persist()
        held.append(met)
        ends = met.select(F.col("src").alias("node_id")).union(met.select("dst")).distinct()
        frontier = ends.join(reached.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(frontier)
        touched = met if touched is None else touched.union(met)
    if touched is None:
        known = graph.edges() if edges is None else edges
        touched = known.limit(0) if known is not None else seeds.sparkSession.createDataFrame([], "type string, src string, dst string")
    return reached, touched.distinct()


def _edges_at(graph: Graph, frontier: DataFrame, types: list[str], labels: set[str]) -> DataFrame | None:
    """Edges with an end in the frontier, whose nodes have the labels; keys are compared as their own type."""
    out = None
    keys = {}
    for name in types:
        spec = graph.rel_specs[name]
        for end, label in (("_src", spec.source), ("_dst", spec.target)):
            if label not in labels:
                continue
            if label not in keys:
                mine = frontier.where(F.col("node_id").startswith(f"{label}:"))
                keys[label] = mine.select(F.expr(f"substring(node_id, {len(label) + 2})").cast(graph.key_type(label)).alias("near"))
            rel, near = graph.rels[name], keys[label]
            one = rel.join(near, rel[end] == near["near"], "left_semi").select(F.lit(name).alias("type"), node_id(spec.source, F.col("_src")).alias("src"), node_id(spec.target, F.col("_dst")).alias("dst"))
            out = one if out is None else out.union(one)
    return out


def shortest_hops(edges: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """``node_id``, ``hops``: the fewest directed edges from any start, up to ``limit``."""
    reached = starts.select("node_id").distinct().withColumn("hops", F.lit(0))
    frontier = reached
    for depth in range(1, limit + 1):
        step = frontier.join(edges, frontier["node_id"] == edges["src"]).select(F.col("dst").alias("node_id")).distinct()
        frontier = step.join(reached, "node_id", "left_anti").withColumn("hops", F.lit(depth))
        reached = reached.unionByName(frontier)
    return reached


def searched_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and not c.startswith("_")]


def text_hits(graph: Graph, query: str, labels: list[str], top_k: int, root: str | None = None, text_index: Callable[[str], textindex.TextIndex] | None = None) -> DataFrame | None:
    """BM25 hits of each table, at most ``top_k`` of each, ranked by table and then by score.

    ``text_index`` gives a label's index. Without it a table made of files is searched by its stored index below ``root`` (the session's shared
    folder by default), any other by a scan.
    """
    out = None
    for order, label in enumerate(labels):
        df, spec = graph.nodes[label], graph.node_specs[label]
        columns = searched_columns(df)
        terms = bm.query_terms(df.sparkSession, query)
        if not columns or not terms:
            continue
        index = text_index(label) if text_index else textindex.index_for(df, spec.key, columns, root or textindex.shared_root(df.sparkSession))
        hits = index.search(terms, k=top_k) if index else bm.bm25(df, spec.key, columns, terms)
        hits = hits.orderBy(F.desc("score"), "key").limit(top_k)
        one = hits.select(node_id(label, F.col("key")).alias("node_id"), F.lit(label).alias("label"), F.lit(order).alias("table"), "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    return out.withColumn("rank", F.row_number().over(Window.orderBy("table", F.desc("score"), "node_id"))).select("node_id", "label", "score", "rank")


def vector_hits(graph: Graph, query: list[float], labels: list[str], top_k: int, codec: str = "fp32", nearest: Callable[[str, list[float], int], DataFrame] | None = None) -> DataFrame | None:
    """The rows of all tables nearest to the query. ``nearest`` gives a label's (``key``, ``score``); without it all vectors or codes are scanned."""
    out = None
    for label in labels:
        df, spec = graph.nodes[label], graph.node_specs[label]
        if "embedding" not in df.columns:
            continue
        code = "_emb_code" if codec != "fp32" and "_emb_code" in df.columns else None
        found = nearest(label, query, top_k) if nearest else vectors.top_k(df, spec.key, "embedding", query, top_k, codec, code)
        one = found.select(node_id(label, F.col("key")).alias("node_id"), F.lit(label).alias("label"), "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= top_k)


@dataclass
class SearchResult:
    seeds: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vector_status: str | None
    pending_embeddings: int = 0
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what the search keeps; call it once seeds, nodes and edges are read."""
        for df in self.held:
            df.unpersist()


def candidate_labels(graph: Graph, labels: list[str] | None) -> list[str]:
    """The asked labels that exist, in their order, else the searchable ones, else all."""
    return [n for n in labels if n in graph.nodes] if labels else [n for n, s in graph.node_specs.items() if s.searchable] or graph.visible_labels()


def search(
    graph: Graph, query: str, vector: list[float] | None = None, labels: list[str] | None = None, top_k: int = TOP_K, hops: int = 1, cap: int = LABEL_CAP, codec: str = "fp32", embedder: embed.Embedder | None = None, root: str | None = None,
    text_index: Callable[[str], textindex.TextIndex] | None = None, nearest: Callable[[str, list[float], int], DataFrame] | None = None, lists: Adjacency | None = None,
) -> SearchResult:
    """Text and vector hits fused, made diverse and expanded.

    The query's vector is given or made by the embedder; without either the text hits decide alone (``vector_status`` off), as they do
    if vectors fail (error). A blank query has no hits and no status.
    """
    names = candidate_labels(graph, labels)
    spark = next(iter(graph.nodes.values())).sparkSession
    empty = spark.createDataFrame([], "node_id string, label string, score double, rank int")
    fts = near = status = None
    if query.strip():
        fts, status = text_hits(graph, query, names, top_k, root, text_index), "off"
        try:
            vector = vector or (embedder.embed([query])[0] if embedder else None)
            if vector:
                near, status = vector_hits(graph, vector, names, top_k, codec, nearest), "on"
        except Exception:  # whatever an embedder raises
            near, status = None, "error"
    pending = sum(embed.pending_count(graph.nodes[n]) for n in names) if embedder else 0
    fused = fuse(empty if fts is None else fts, empty if near is None else near)
    # a handful of rows that several plans read
    seeds = diversify(fused, top_k, cap).persist()
    held = [seeds]
    nodes, edges = expand(graph, seeds, hops, held=held, lists=lists)
    return SearchResult(seeds, nodes, edges, status, pending, held)


def resolve_keys(graph: Graph, ids: list[str]) -> DataFrame:
    """``node_id`` of each asked id: ``Label:key``, or a bare key that one label alone has. Each table is asked for its own keys."""
    spark = next(iter(graph.nodes.values())).sparkSession
    full = [i for i in ids if i.partition(":")[0] in graph.nodes]
    bare = list(dict.fromkeys(i for i in ids if i not in full))
    hits = spark.createDataFrame([], "node_id string")
    found: dict[str, list[str]] = {}
    for label in graph.node_specs:
        df, key = graph.nodes[label], graph.node_specs[label].key
        kind = graph.key_type(label)
        own = [i.partition(":")[2] for i in full if i.partition(":")[0] == label]
        asked = own + ([] if label.startswith("_") else bare)
        if not asked:
            continue
        # the text of a key need not be the one a number is written with: compare both, the typed one prunes the scan
        rows = df.where(F.col(key).isin([F.lit(a).try_cast(kind) for a in asked])).where(F.col(key).cast("string").isin(asked))
        rows = rows.select(node_id(label, F.col(key)).alias("node_id"), F.col(key).cast("string").alias("key"))
        if own:
            hits = hits.union(rows.where(F.col("key").isin(own)).select("node_id"))
        if bare and not label.startswith("_"):
            for r in rows.where(F.col("key").isin(bare)).collect():  # as many as were asked for
                found.setdefault(r["key"], []).append(r["node_id"])
    for key in bare:
        if len(found.get(key, [])) != 1:
            raise SchemaError(f"'{key}' names {'no' if key not in found else 'more than one'} node", "Give it as Label:key.")
    if bare:
        hits = hits.union(spark.createDataFrame([(found[k][0],) for k in bare], "node_id string"))
    return hits
