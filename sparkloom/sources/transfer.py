"""Portable JSON-lines export and import of a graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TYPES, VECTOR_COLUMNS, Graph, node_id
from ..errors import SchemaError
from ..session import scratch_folder

FORMAT, VERSION = "graph_export", 1
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def export_lines(graph: Graph) -> DataFrame:
    """``line``, in order by ``part`` and ``place``: header, schema, nodes by label and key, edges by type and ends. Vectors are derived and stay out; nulls are left out."""
    spark = next(iter(graph.nodes.values())).sparkSession
    labels, rels = sorted(graph.visible_labels()), sorted(graph.visible_rels())
    schema = {
        "type": "schema",
        "node_tables": [{"name": n, "key": graph.node_specs[n].key, "key_type": _kind(graph.key_type(n).simpleString()), "properties": graph.node_specs[n].properties, "searchable": graph.node_specs[n].searchable} for n in labels],
        "rel_tables": [{"name": n, "from": graph.rel_specs[n].source, "to": graph.rel_specs[n].target, "properties": graph.rel_specs[n].properties} for n in rels],
    }
    head = [json.dumps({"type": FORMAT, "format_version": VERSION}), json.dumps(schema, ensure_ascii=False)]
    out = spark.createDataFrame([(k, "", line) for k, line in enumerate(head)], "part int, place string, line string")
    for k, label in enumerate(labels, 2):
        df, key = graph.nodes[label], graph.node_specs[label].key
        props = [c for c in df.columns if c not in VECTOR_COLUMNS and c not in (key, "_source", "_created_at")]
        rest = [F.col(c).alias(a) for c, a in (("_source", "source"), ("_created_at", "created_at")) if c in df.columns]
        line = F.to_json(F.struct(F.lit("node").alias("type"), F.lit(label).alias("label"), F.col(key).alias("key"), F.struct(*props).alias("properties") if props else F.lit(None).alias("properties"), *rest), _JSON)
        out = out.unionByName(df.select(F.lit(k).alias("part"), F.col(key).cast("string").alias("place"), line.alias("line")))
    for k, name in enumerate(rels, 2 + len(labels)):
        df, spec = graph.rels[name], graph.rel_specs[name]
        props = [c for c in df.columns if c not in ("_src", "_dst", "_source")]
        rest = [F.col("_source").alias("source")] if "_source" in df.columns else []
        ends = (F.lit("edge").alias("type"), F.lit(name).alias("rel"), node_id(spec.source, F.col("_src")).alias("from"), node_id(spec.target, F.col("_dst")).alias("to"))
        out = out.unionByName(df.select(F.lit(k).alias("part"), F.concat_ws(">", "_src", "_dst").alias("place"), F.to_json(F.struct(*ends, *([F.struct(*props).alias("properties")] if props else []), *rest), _JSON).alias("line")))
    return out


def _kind(simple: str) -> str:
    return {"bigint": "INT64", "int": "INT64", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOL", "date": "DATE", "timestamp": "TIMESTAMP"}.get(simple, "STRING")


def export_graph(graph: Graph, path: str) -> None:
    """Files in the order of the lines, as many as their size asks for: a large table is dealt to many tasks by ranges of its keys."""
    export_lines(graph).repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)


def import_graph(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph, and lines of unknown kinds or with missing ends (``line``, ``warning``)."""
    routed = f"{scratch_folder(spark)}/lines"
    known = F.col("type").isin(FORMAT, "schema", "node", "edge")
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.json_tuple("value", "type", "label", "rel").alias("type", "label", "rel"))
    # the one pass over the file: each line goes to the folder of its kind and table, where it is typed
    lines = lines.select("line", F.when(known, F.col("type")).otherwise("other").alias("kind"), F.coalesce(F.when(F.col("type") == "node", F.col("label")).when(F.col("type") == "edge", F.col("rel")), F.lit("-")).alias("name"))
    lines.hint("rebalance", F.col("kind"), F.col("name")).write.partitionBy("kind", "name").parquet(routed)
    lines = spark.read.schema("line string, kind string, name string").parquet(routed)
    part = lambda kind, name: lines.where((F.col("kind") == kind) & (F.col("name") == name)).select("line")
    head = lines.where(F.col("kind").isin(FORMAT, "schema")).select("line", F.col("kind").alias("type")).collect()
    header = next((json.loads(r["line"]) for r in head if r["type"] == FORMAT), None)
    if header is None:
        raise SchemaError("The file has no header line", f"It begins with {{\"type\": \"{FORMAT}\"}}.")
    if header["format_version"] > VERSION:
        raise SchemaError(f"Format version {header['format_version']} is newer than {VERSION}")
    schema = next(json.loads(r["line"]) for r in head if r["type"] == "schema")
    graph = Graph()
    warnings = lines.where("kind = 'other'").select("line", F.lit("unknown kind").alias("warning"))
    spark_type = lambda kind: TYPES[kind].simpleString() if kind in TYPES else kind
    for t in schema["node_tables"]:
        props = ", ".join(f"`{p}`: {spark_type(k)}" for p, k in t["properties"].items() if p not in VECTOR_COLUMNS and p not in ("_source", "_created_at"))
        parsed = part("node", t["name"]).select(F.from_json("line", f"struct<label: string, key: {spark_type(t['key_type'])}, properties: struct<{props}>, source: string, created_at: timestamp>").alias("r"))
        columns = [F.col("r.key").alias(t["key"]), *([F.col("r.properties.*")] if props else []), F.col("r.source").alias("_source"), F.col("r.created_at").alias("_created_at")]
        graph.add_nodes(t["name"], parsed.select(*columns), t["key"], t["searchable"])
    for t in schema["rel_tables"]:
        props = ", ".join(f"`{p}`: {spark_type(k)}" for p, k in t["properties"].items() if p != "_source")
        edges = part("edge", t["name"]).select("line", F.from_json("line", f"struct<rel: string, `from`: string, `to`: string, properties: struct<{props}>, source: string>").alias("r"))
        cut = lambda c, label: F.expr(f"substring(r.`{c}`, {len(label) + 2})").cast(graph.key_type(label))
        edges = edges.select("line", cut("from", t["from"]).alias("_src"), cut("to", t["to"]).alias("_dst"), *([F.col("r.properties.*")] if props else []), F.col("r.source").alias("_source"))
        for end, label in (("_src", t["from"]), ("_dst", t["to"])):
            have = graph.nodes[label].select(F.col(graph.node_specs[label].key).alias("__k"))
            warnings = warnings.unionByName(edges.join(have, edges[end] == have["__k"], "left_anti").select("line", F.lit("missing end").alias("warning")))
            edges = edges.join(have, edges[end] == have["__k"], "left_semi")
        graph.add_rels(t["name"], edges.drop("line"), t["from"], t["to"])
    return graph, warnings
