"""The facade: schema, upserts, read queries, search, context, ingest and transfer over one store."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import VECTOR_COLUMNS, NodeTable, RelTable, type_name
from .errors import NotFoundError, SchemaError
from .functions import codecs
from .functions import text as bm
from .functions import vectors
from .operators import adjacency, chunk, codegraph, embed, mutate, pack, retrieve, subgraph, textindex, vectorindex
from .plans.compiler import cypher
from .plans.parser import check_read_only
from .sources import transfer
from .store import DELETED, GraphStore

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
#: Rows that one search embeds at the most.
EMBED_PER_SEARCH = 256


@dataclass
class QueryResponse:
    columns: list[str]
    rows: list[list[Any]]
    truncated: bool
    subgraph: subgraph.Subgraph = field(default_factory=subgraph.Subgraph)

    @property
    def row_count(self) -> int:
        return len(self.rows)


@dataclass
class ContextResponse:
    text: str
    truncated: bool
    seeds: list[dict[str, Any]]
    vector_status: str | None = None
    pending_embeddings: int = 0

    def with_footer(self) -> str:
        """The context, a rule, and the seeds as JSON with scores of six places: what a tool returns to a language model."""
        seeds = [{k: round(v, 6) if isinstance(v, float) else v for k, v in s.items()} for s in self.seeds]
        return f"{self.text}\n\n---\n{json.dumps({'seeds': seeds}, ensure_ascii=False)}"


@dataclass
class WriteReport:
    written: int
    removed: int = 0
    warnings: list[str] = field(default_factory=list)


class GraphService:
    def __init__(self, store: GraphStore, embedder: embed.Embedder | None = None, codec: str = "fp32"):
        self.store, self.embedder, self.codec = store, embedder, codecs.check_codec(codec)

    # schema

    def describe_schema(self) -> str:
        return self.store.graph().describe_text()

    def define_schema(self, nodes: list[NodeTable], rels: list[RelTable] = (), key_types: dict[str, str] | None = None) -> None:
        self.store.define(list(nodes), list(rels), key_types)

    def add_columns(self, table: str, columns: dict[str, str]) -> None:
        self.store.add_columns(table, columns)

    def _label(self, label: str) -> tuple[DataFrame, str]:
        graph = self.store.graph()
        if label not in graph.nodes:
            raise SchemaError(f"Unknown label {label}", f"Known labels: {', '.join(sorted(graph.nodes))}")
        return graph.nodes[label], graph.node_specs[label].key

    def _type(self, name: str) -> tuple[DataFrame, RelTable]:
        graph = self.store.graph()
        if name not in graph.rels:
            raise SchemaError(f"Unknown relationship type {name}", f"Known types: {', '.join(sorted(graph.rels))}")
        return graph.rels[name], graph.rel_specs[name]

    # writing

    def _merged(self, name: str, batch: DataFrame, restore: bool = False) -> DataFrame:
        """The rows that a batch of a table leaves, one a key. Of the table only what has the batch's keys is read."""
        keys = self.store.keys(name)
        old = self.store.rows_of(name, batch)
        new = mutate.upsert(old, batch, keys, restore=restore)
        held = [c for c in VECTOR_COLUMNS if c in old.columns]
        if held and len(keys) == 1:
            new = mutate.invalidate_embeddings(old, new, keys[0], self._texts(old, keys[0]), held)
        return new

    def _texts(self, df: DataFrame, key: str) -> list[str]:
        return [c for c, t in df.dtypes if t == "string" and not c.startswith("_") and c != key]

    def _write(self, changes: dict[str, DataFrame]) -> dict[str, int]:
        """Merge changed rows into tables; tables with many deltas are folded, after their indexes have seen them."""
        counts = self.store.merge(changes)
        for name in changes:
            if self.store.crowded(name):
                self.compact(name)
        return counts

    def compact(self, name: str) -> int:
        """Fold a table's deltas into its base; how many."""
        entry = self.store.entry(name)
        if "key" in entry and entry["searchable"]:
            df, _ = self._label(name)
            if columns := retrieve.searched_columns(df):
                textindex.index_of(self.store, name, columns)
            if "embedding" in df.columns:
                vectorindex.index_of(self.store, name)
        return self.store.compact(name)

    def index_relationships(self) -> int:
        """Write neighbour lists, which expansions read from then on as long as changes can be laid over them; how many edges they hold."""
        lists = adjacency.adjacency_of(self.store)
        return lists.state["edges"] if lists else 0

    def _lists(self) -> adjacency.Adjacency | None:
        return adjacency.adjacency_of(self.store, make=False)

    def vacuum(self, keep: int = 10, older_than_s: float = 86_400.0) -> int:
        """Remove earlier versions but the newest ``keep``, and the folders that only they name; see :meth:`GraphStore.vacuum`."""
        return self.store.vacuum(keep, older_than_s)

    def upsert_nodes(self, label: str, batch: DataFrame) -> WriteReport:
        """Merge rows by key (``_ordinal`` orders repeats). Changed text takes a row's vectors with it. ``written`` counts keys."""
        old, key = self._label(label)
        clean, warnings = mutate.sanitize(batch, old, [key])
        clean = self._ordered(clean).persist()
        written = self._write({label: self._merged(label, clean)})
        clean.unpersist()
        return WriteReport(written[label], 0, warnings)

    def upsert_edges(self, name: str, batch: DataFrame) -> WriteReport:
        table, spec = self._type(name)
        clean, warnings = mutate.sanitize(batch, table, ["_src", "_dst"])
        clean = self._ordered(clean).persist()
        ends = []
        for end, label in (("_src", spec.source), ("_dst", spec.target)):
            key = self.store.keys(label)[0]
            ends += [self.store.rows_of(label, clean.select(F.col(end).alias(key))), key]
        mutate.check_ends(clean, *ends)
        written = self._write({name: self._merged(name, clean)})
        clean.unpersist()
        return WriteReport(written[name], 0, warnings)

    def create_nodes(self, label: str, batch: DataFrame) -> WriteReport:
        """Add rows whose keys must be new."""
        old, key = self._label(label)
        taken = batch.join(old.select(F.col(key).alias("__k")), batch[key] == F.col("__k"), "left_semi").select(F.col(key).cast("string").alias("k")).limit(5).collect()
        if taken:
            raise SchemaError(f"{label} has the keys already: {', '.join(r['k'] for r in taken)}", "Upsert them instead.")
        return self.upsert_nodes(label, batch)

    def create_edges(self, name: str, batch: DataFrame) -> WriteReport:
        return self.upsert_edges(name, batch)

    def set_properties(self, label: str, keys: list[Any], values: dict[str, Any]) -> int:
        """Set columns of the rows with the keys, None clears; the number of rows."""
        table, key = self._label(label)
        if unknown := [c for c in values if c not in table.columns or c == key]:
            raise SchemaError(f"{label} has no columns {', '.join(unknown)} to set", f"Columns: {', '.join(c for c in table.columns if c != key)}")
        rows = self.store.rows_of(label, self._keyed(table, key, keys))
        new = mutate.set_values(rows, F.lit(True), {c: F.lit(v) for c, v in values.items()})
        if held := [c for c in VECTOR_COLUMNS if c in table.columns]:
            new = mutate.invalidate_embeddings(rows, new, key, self._texts(table, key), held)
        return self._write({label: new})[label]

    def _keyed(self, table: DataFrame, key: str, keys: list[Any]) -> DataFrame:
        return table.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(key, table.schema[key].dataType)]))

    def delete_nodes(self, label: str, keys: list[Any]) -> int:
        """Delete nodes and the relationships that touch them; the number of nodes."""
        table, key = self._label(label)
        return self._remove(label, self.store.rows_of(label, self._keyed(table, key, keys)), key)

    def delete_edges(self, name: str, pairs: list[tuple[Any, Any]]) -> int:
        """Delete the relationships between the pairs of keys; their number."""
        table, _ = self._type(name)
        schema = T.StructType([table.schema["_src"], table.schema["_dst"]])
        gone = self.store.rows_of(name, table.sparkSession.createDataFrame(pairs, schema))
        return self._write({name: gone.select("_src", "_dst").distinct().withColumn(DELETED, F.lit(True))})[name]

    def _remove(self, label: str, removed: DataFrame, key: str, changed: DataFrame | None = None) -> int:
        """Delete rows of a label and the relationships to them, and merge its ``changed`` rows, in one version; the number of rows deleted."""
        graph = self.store.graph()
        gone = removed.select(F.col(key)).distinct().persist()
        number = gone.count()
        marks = gone.withColumn(DELETED, F.lit(True))
        changes = {label: marks if changed is None else changed.withColumn(DELETED, F.lit(False)).unionByName(marks, allowMissingColumns=True)}
        if number:
            for name, spec in graph.rel_specs.items():
                rels = graph.rels[name]
                for end, at in (("_src", spec.source), ("_dst", spec.target)):
                    if at == label:
                        touching = rels.join(gone, rels[end] == gone[key], "left_semi").select("_src", "_dst").withColumn(DELETED, F.lit(True))
                        changes[name] = touching if name not in changes else changes[name].union(touching)
                if name in changes:
                    changes[name] = changes[name].distinct()
        self._write(changes)
        gone.unpersist()
        return number

    def _ordered(self, batch: DataFrame) -> DataFrame:
        """Without ``_ordinal`` rows follow the batch's own order; give it where the batch comes out of a shuffle and repeats keys."""
        return batch if mutate.ORDINAL in batch.columns else batch.withColumn(mutate.ORDINAL, F.monotonically_increasing_id())

    # reading

    def procedures(self) -> dict[str, Any]:
        """Search as procedures of CALL: ``node`` and ``score`` (text), ``node`` and ``distance`` (vectors)."""
        graph = self.store.graph()

        def whole(label: str, hits: DataFrame, value: str) -> DataFrame:
            df, key = graph.nodes[label], graph.node_specs[label].key
            shown = [c for c in df.columns if c not in VECTOR_COLUMNS]
            node = F.struct(F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("_id"), F.lit(label).alias("_label"), *[F.col(f"`{c}`") for c in shown])
            return df.join(F.broadcast(hits), df[key] == hits["key"]).select(node.alias("node"), value)

        def query_text(label: str, index: str, query: str, top: int = 10) -> DataFrame:
            df, key = self._label(label)
            terms, columns = bm.query_terms(df.sparkSession, query), retrieve.searched_columns(df)
            hits = textindex.index_of(self.store, label, columns).search(terms, k=top) if terms and columns else bm.bm25(df, key, columns, terms)
            return whole(label, hits.orderBy(F.desc("score"), "key").limit(top), "score").orderBy(F.desc("score"))

        def query_vectors(label: str, index: str, vector: list[float], k: int = 10) -> DataFrame:
            df, key = self._label(label)
            if "embedding" not in df.columns:
                raise NotFoundError(f"{label} has no vectors", "Embed it first.")
            hits = self._nearest(label, vector, k)
            return whole(label, hits.select("key", (1 - F.col("score")).alias("distance")), "distance").orderBy("distance")

        return {"QUERY_FTS_INDEX": query_text, "QUERY_VECTOR_INDEX": query_vectors}

    def _nearest(self, label: str, vector: list[float], k: int) -> DataFrame:
        """The ``k`` nearest rows, exactly: by the index's cells, or by the codes where the service keeps some."""
        df, key = self._label(label)
        if self.codec != "fp32" and "_emb_code" in df.columns:
            return vectors.top_k(df, key, "embedding", vector, k, self.codec, "_emb_code")
        return vectorindex.index_of(self.store, label).search(vector, k)

    def _text_index(self, label: str) -> textindex.TextIndex:
        return textindex.index_of(self.store, label, retrieve.searched_columns(self._label(label)[0]))

    def cypher_query(self, text: str, params: dict[str, Any] | None = None, limit: int | None = None) -> QueryResponse:
        check_read_only(text)
        limit = max(1, min(limit or DEFAULT_LIMIT, MAX_LIMIT))
        out = cypher(self.store.graph(), text, params, self.procedures())
        rows = out.limit(limit + 1).collect()
        return QueryResponse(out.columns, [list(r) for r in rows[:limit]], len(rows) > limit, subgraph.of_rows(rows[:limit]))

    def sample_graph(self, n: int = 100) -> dict[str, Any]:
        """Some nodes, edges between them, and the counts of all tables."""
        nodes, edges, stats = self.store.graph().sample(max(1, min(n, MAX_LIMIT)))
        return {"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()], "tables": [r.asDict() for r in stats.collect()]}

    def _context(self, seeds: list[str], nodes: DataFrame, edges: DataFrame, budget: int | None) -> tuple[str, bool]:
        """Lines of the nodes, seeds first, then of the edges, within the budget. A budget bounds what is collected."""
        graph = self.store.graph()
        most = 4 * max(1, budget or retrieve.TOKEN_BUDGET)
        near = [r["node_id"] for r in nodes.orderBy("depth", "node_id").limit(most).collect()]
        by_label: dict[str, list[str]] = {}
        for node in dict.fromkeys([*seeds, *near]):
            by_label.setdefault(node.partition(":")[0], []).append(node)
        lines = {}
        for label, ids in by_label.items():
            df, key = graph.nodes[label], graph.node_specs[label].key
            asked = [i.partition(":")[2] for i in ids]
            typed = F.col(key).isin([F.lit(a).try_cast(graph.key_type(label)) for a in asked])  # reaches the files' statistics
            for row in df.where(typed & F.col(key).cast("string").isin(asked)).collect():
                props = {k: v for k, v in row.asDict().items() if k not in VECTOR_COLUMNS}
                lines[f"{label}:{row[key]}"] = pack.node_line(f"{label}:{row[key]}", props)
        ordered = [lines[i] for i in dict.fromkeys([*seeds, *near]) if i in lines]
        links = [pack.edge_line(r["src"], r["type"], r["dst"]) for r in edges.orderBy("type", "src", "dst").limit(most).collect()]
        return pack.pack(ordered + links, budget)

    def search_knowledge(self, query: str, vector: list[float] | None = None, labels: list[str] | None = None, top_k: int = retrieve.TOP_K, hops: int = 1, token_budget: int | None = None) -> ContextResponse:
        """Text and vector search, expanded and packed. With an embedder up to EMBED_PER_SEARCH rows that wait for vectors get them first."""
        if self.embedder and query.strip():
            for label in retrieve.candidate_labels(self.store.graph(), labels):
                self.embed_pending(label, EMBED_PER_SEARCH)
        found = retrieve.search(self.store.graph(), query, vector, labels, top_k, hops, codec=self.codec, embedder=self.embedder, text_index=self._text_index, nearest=self._nearest, lists=self._lists())
        seeds = [r.asDict() for r in found.seeds.orderBy("seed_rank").collect()]
        text, cut = self._context([s["node_id"] for s in seeds], found.nodes, found.edges, token_budget)
        found.release()
        return ContextResponse(text, cut, seeds, found.vector_status, found.pending_embeddings)

    def get_context(self, ids: list[str], hops: int = 1, token_budget: int | None = None) -> ContextResponse:
        graph = self.store.graph()
        seeds = retrieve.resolve_keys(graph, ids)
        held: list[DataFrame] = []
        nodes, edges = retrieve.expand(graph, seeds, hops, held=held, lists=self._lists())
        have = {r["node_id"] for r in seeds.collect()}  # as many as were asked for
        asked = {n.partition(":")[2]: n for n in have}
        names = list(dict.fromkeys(n for i in ids if (n := i if i in have else asked.get(i)) in have))
        text, cut = self._context(names, nodes, edges, token_budget)
        for df in held:
            df.unpersist()
        return ContextResponse(text, cut, [{"node_id": n} for n in names])

    # vectors

    def embed_pending(self, label: str, most: int | None = None) -> int:
        """Make the vectors that are missing, ``most`` at once if given; how many were made."""
        if self.embedder is None:
            return 0
        df, key = self._label(label)
        waiting = embed.pending_count(df) if "embedding" in df.columns else df.count()
        if waiting:
            self.store.provision(label, embed.VECTOR_TYPES)
            self._write({label: embed.made_pending(self.store.table(label), key, self.embedder, self.codec, most)})
        return waiting if most is None else min(waiting, most)

    def pending_embeddings(self, label: str) -> int:
        return embed.pending_count(self._label(label)[0]) if self.embedder else 0

    def reindex(self, label: str) -> int:
        """Make all vectors of a label anew; how many."""
        if self.embedder is None:
            raise SchemaError("No embedder is configured")
        df, key = self._label(label)
        self.store.replace({label: embed.reindex(df, key, self.embedder, self.codec)})
        return df.count()

    # documents, code and files

    def ingest(self, docs: DataFrame, label: str = "Chunk", size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> WriteReport:
        """Chunk documents (``text``, ``source``, ``metadata``, ``ordinal``) and merge them; chunks that a document or source no longer gives go."""
        self.store.define([NodeTable(label, "id", {"text": "STRING", "meta": "STRING"}, True)], [])
        old, key = self._label(label)
        chunks = chunk.chunk_documents(docs, size, overlap).withColumnRenamed("chunk", mutate.ORDINAL).persist()
        owners = chunks.select(F.regexp_replace("id", "#[0-9]+$", "").alias("prefix"))
        _, first = mutate.prune_prefix(old, chunks, "id", owners)
        _, second = mutate.prune_sources(old, chunks, "id", docs.where("source IS NOT NULL").select(F.col("source").alias("_source")))
        written = chunks.count()
        removed = self._remove(label, first.select(key).union(second.select(key)), key, self._merged(label, chunks))
        chunks.unpersist()
        self.embed_pending(label)
        return WriteReport(written, removed)

    def ingest_code(self, root: str, **options: Any) -> codegraph.CodeReport:
        return codegraph.ingest_code(self, root, **options)

    def export_to(self, path: str) -> None:
        transfer.export_graph(self.store.graph(), path)

    def import_from(self, path: str) -> WriteReport:
        """Replay an export: tables that are missing are made, rows are merged by key with their creation times, edges without ends are warned of.

        Doing it twice changes nothing.
        """
        spark = self.store.spark
        found, bad = transfer.import_graph(spark, path)
        nodes = [NodeTable(n, s.key, {p: k for p, k in s.properties.items() if not p.startswith("_")}, s.searchable) for n, s in found.node_specs.items()]
        rels = [RelTable(n, s.source, s.target, {p: k for p, k in s.properties.items() if not p.startswith("_")}) for n, s in found.rel_specs.items()]
        self.store.define(nodes, rels, {n: type_name(found.key_type(n).simpleString()) for n in found.node_specs})
        ordered = lambda df: df.withColumn(mutate.ORDINAL, F.monotonically_increasing_id())
        batches = {name: ordered(df) for name, df in found.nodes.items()} | {name: ordered(df) for name, df in found.rels.items()}
        counts = self._write({name: self._merged(name, df, restore=name in found.nodes) for name, df in batches.items()})
        warned = bad.groupBy("warning").agg(F.count("*").alias("n"), F.min("line").alias("line")).collect()
        return WriteReport(sum(counts.values()), 0, [f"{r['warning']}: {r['n']} lines, as {r['line']}" for r in warned])
