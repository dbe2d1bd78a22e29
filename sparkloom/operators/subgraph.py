"""Subgraphs: taken out of result rows, merged, filtered, and rows with their nodes laid out as columns."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = {"embedding", "_emb_code", "_id", "_label", "_src", "_dst", "_type"}


@dataclass
class Subgraph:
    """Nodes and edges by id; whoever comes first stays."""

    nodes: dict[str, dict[str, Any]] = field(default_factory=dict)
    edges: dict[str, dict[str, Any]] = field(default_factory=dict)

    def merge(self, other: "Subgraph") -> "Subgraph":
        return Subgraph(other.nodes | self.nodes, other.edges | self.edges)

    def matching(self, needle: str) -> "Subgraph":
        """Nodes whose id or properties hold the text, and the edges between them."""
        low = needle.lower()
        nodes = {k: n for k, n in self.nodes.items() if low in k.lower() or low in json.dumps(n["properties"], ensure_ascii=False, default=str).lower()}
        return Subgraph(nodes, {k: e for k, e in self.edges.items() if e["source"] in nodes and e["target"] in nodes})


def _shown(value: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in value.items() if k not in HIDDEN and v is not None}


def _collect(value: Any, out: Subgraph) -> None:
    if isinstance(value, Row):
        value = value.asDict()
        if value.get("_id") is not None and "_label" in value:
            out.nodes.setdefault(value["_id"], {"id": value["_id"], "label": value["_label"], "properties": _shown(value)})
        elif value.get("_type") is not None and "_src" in value:
            ident = f"{value['_type']}:{value['_src']}->{value['_dst']}"
            out.edges.setdefault(ident, {"id": ident, "type": value["_type"], "source": value["_src"], "target": value["_dst"], "properties": _shown(value)})
        else:
            _collect(list(value.values()), out)
    elif isinstance(value, dict):
        _collect(list(value.values()), out)
    elif isinstance(value, (list, tuple)):
        for x in value:
            _collect(x, out)


def of_rows(rows: Iterable[Row]) -> Subgraph:
    """The nodes and edges that stand in the cells, in lists and in paths of collected rows."""
    out = Subgraph()
    for row in rows:
        _collect(list(row), out)
    return out


def subgraph_frames(df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(``id``, ``label``, ``properties`` as JSON; ``id``, ``type``, ``src``, ``dst``) of the node and relationship columns of a whole result."""
    nodes = edges = None
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StructType):
            continue
        names, c = f.dataType.names, F.col(f"`{f.name}`")
        if "_id" in names and "_label" in names:
            shown = F.to_json(F.struct(*[c[n].alias(n) for n in names if n not in HIDDEN])) if set(names) - HIDDEN else F.lit("{}")
            one = df.where(c["_id"].isNotNull()).select(c["_id"].alias("id"), c["_label"].alias("label"), shown.alias("properties"))
            nodes = one if nodes is None else nodes.unionByName(one)
        elif "_type" in names and "_src" in names:
            ident = F.concat(c["_type"], F.lit(":"), c["_src"], F.lit("->"), c["_dst"])
            one = df.where(c["_type"].isNotNull()).select(ident.alias("id"), c["_type"].alias("type"), c["_src"].alias("src"), c["_dst"].alias("dst"))
            edges = one if edges is None else edges.unionByName(one)
    first = lambda x: None if x is None else merge_frames([x])
    return first(nodes), first(edges)


def merge_frames(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """All frames together, one row for each key: of the first frame that has it, and there the least."""
    out = None
    for k, df in enumerate(frames):
        one = df.withColumn("__frame", F.lit(k))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in out.columns if c not in (key, "__frame")]
    least = out.groupBy(key).agg(F.min(F.struct("__frame", *rest)).alias("__least"))
    return least.select(key, *[F.col(f"__least.`{c}`").alias(c) for c in rest])


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def laid_out(df: DataFrame) -> DataFrame:
    """``df`` with each node or relationship column as its properties: ``n.name`` and so on; the id stays as ``n``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType) and {"_id", "_label"} <= set(f.dataType.names) or isinstance(f.dataType, T.StructType) and {"_type", "_src", "_dst"} <= set(f.dataType.names):
            is_node = "_id" in f.dataType.names
            out.append((c["_id"] if is_node else F.concat(c["_type"], F.lit(":"), c["_src"], F.lit("->"), c["_dst"])).alias(f.name))
            out += [c[n].alias(f"{f.name}.{n}") for n in f.dataType.names if n not in HIDDEN]
        else:
            out.append(c)
    return df.select(*out)


def filtered(nodes: DataFrame, edges: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``properties``) that hold the text anywhere, and the edges (``src``, ``dst``) of which both ends are left."""
    low = needle.lower()
    kept = nodes.where(F.lower("id").contains(low) | F.lower("properties").contains(low))
    ids = kept.select(F.col("id").alias("__id"))
    return kept, edges.join(ids, edges["src"] == F.col("__id"), "left_semi").join(ids, edges["dst"] == F.col("__id"), "left_semi")
