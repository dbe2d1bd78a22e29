"""The declared schema of a graph and the DataFrames that hold its tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
TYPES: dict[str, T.DataType] = {"STRING": T.StringType(), "INT64": T.LongType(), "DOUBLE": T.DoubleType(), "BOOL": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}
VECTOR_COLUMNS = ("embedding", "_emb_r", "_emb_code", "_emb_model")


def check_identifier(name: str) -> str:
    if not IDENTIFIER.match(name or ""):
        raise SchemaError(f"'{name}' is not a valid name", "Names are a letter or underscore, then letters, digits and underscores.")
    return name


@dataclass
class NodeTable:
    name: str
    key: str
    properties: dict[str, str] = field(default_factory=dict)
    searchable: bool = False


@dataclass
class RelTable:
    name: str
    source: str
    target: str
    properties: dict[str, str] = field(default_factory=dict)


class Graph:
    """Node tables by label and relationship tables by type. A relationship DataFrame has ``_src`` and ``_dst``, the keys of its ends."""

    def __init__(self):
        self.node_specs: dict[str, NodeTable] = {}
        self.rel_specs: dict[str, RelTable] = {}
        self.nodes: dict[str, DataFrame] = {}
        self.rels: dict[str, DataFrame] = {}

    def copy(self) -> "Graph":
        out = Graph()
        out.node_specs, out.rel_specs, out.nodes, out.rels = dict(self.node_specs), dict(self.rel_specs), dict(self.nodes), dict(self.rels)
        return out

    def add_nodes(self, label: str, df: DataFrame, key: str, searchable: bool = False) -> "Graph":
        check_identifier(label)
        if key not in df.columns:
            raise SchemaError(f"Table {label} has no column {key}")
        types = {c: type_name(t) for c, t in df.dtypes if c != key}
        self.node_specs[label], self.nodes[label] = NodeTable(label, key, types, searchable), df
        return self

    def add_rels(self, name: str, df: DataFrame, source: str, target: str) -> "Graph":
        check_identifier(name)
        for label in (source, target):
            if label not in self.node_specs:
                raise SchemaError(f"Relationship {name} refers to the unknown label {label}", f"Known labels: {', '.join(sorted(self.node_specs))}")
        if (old := self.rel_specs.get(name)) and (old.source, old.target) != (source, target):
            raise SchemaError(f"Relationship {name} already joins {old.source} to {old.target}")
        types = {c: type_name(t) for c, t in df.dtypes if c not in ("_src", "_dst")}
        self.rel_specs[name], self.rels[name] = RelTable(name, source, target, types), df
        return self

    def key_type(self, label: str) -> T.DataType:
        return self.nodes[label].schema[self.node_specs[label].key].dataType

    def visible_labels(self) -> list[str]:
        """Labels that an unlabelled pattern spans: internal tables begin with an underscore and stay hidden."""
        return [label for label in self.node_specs if not label.startswith("_")]

    def visible_rels(self) -> list[str]:
        return [n for n, r in self.rel_specs.items() if not n.startswith("_") and not r.source.startswith("_") and not r.target.startswith("_")]

    def scan_ids(self) -> DataFrame:
        """Canonical ids of all visible nodes: ``node_id``, ``label``."""
        out = None
        for label in self.visible_labels():
            one = self.nodes[label].select(node_id(label, F.col(self.node_specs[label].key)).alias("node_id"), F.lit(label).alias("label"))
            out = one if out is None else out.unionByName(one)
        return out

    def edges(self) -> DataFrame:
        """All visible relationships: ``type``, ``src``, ``dst`` (canonical ids)."""
        out = None
        for name in self.visible_rels():
            spec = self.rel_specs[name]
            one = self.rels[name].select(F.lit(name).alias("type"), node_id(spec.source, F.col("_src")).alias("src"), node_id(spec.target, F.col("_dst")).alias("dst"))
            out = one if out is None else out.unionByName(one)
        return out

    # catalog documents

    def table_info(self, name: str) -> list[tuple]:
        """(number, number, column, type, is key, is key) of each column that a query can name; keys of a relationship are those of its ends."""
        if name in self.node_specs:
            df, key = self.nodes[name], self.node_specs[name].key
        elif name in self.rel_specs:
            df, key = self.rels[name].drop("_src", "_dst"), None
        else:
            raise SchemaError(f"Unknown table {name}", f"Known: {', '.join([*self.visible_labels(), *self.visible_rels()])}")
        kind = lambda c, t: "FLOAT[]" if c == "embedding" else "BLOB" if t == "binary" else type_name(t)
        return [(k, k, c, kind(c, t), c == key, c == key) for k, (c, t) in enumerate(df.dtypes)]

    def endpoints(self, name: str) -> tuple[str, str, str, str]:
        """Labels and keys of a relationship's ends: source, its key, target, its key."""
        if name not in self.rel_specs:
            raise SchemaError(f"Unknown relationship type {name}", f"Known types: {', '.join(sorted(self.visible_rels()))}")
        spec = self.rel_specs[name]
        return spec.source, self.node_specs[spec.source].key, spec.target, self.node_specs[spec.target].key

    def sample(self, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Up to ``n`` nodes (``node_id``, ``label``), up to ``n`` edges that join two of them, and the table counts."""
        nodes = self.scan_ids().limit(n).persist()
        few = F.broadcast(nodes.select(F.col("node_id").alias("near")))
        edges = self.edges()
        kept = edges.join(few, edges["src"] == F.col("near"), "left_semi").join(few, edges["dst"] == F.col("near"), "left_semi").limit(n)
        return nodes, kept, self.table_stats()

    def table_stats(self) -> DataFrame:
        """``name``, ``kind``, ``n`` for each visible table."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit("node").alias("kind"), "n") for n, df in self.nodes.items() if not n.startswith("_")]
        parts += [self.rels[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit("rel").alias("kind"), "n") for n in self.visible_rels()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def sample_keys(self, label: str, n: int = 5) -> DataFrame:
        key = self.node_specs[label].key
        return self.nodes[label].select(F.col(key).cast("string").alias("key")).orderBy(F.col(key)).limit(n)

    def describe_text(self, counts: bool = True, samples: bool = True) -> str:
        lines = []
        for label in sorted(self.visible_labels()):
            spec = self.node_specs[label]
            props = ", ".join([f"{spec.key}:{type_name(self.key_type(label).simpleString())} PK", *(f"{p}:{t}" for p, t in spec.properties.items() if p not in VECTOR_COLUMNS and not p.startswith("_"))])
            tail = [f"{self.nodes[label].count()} rows"] * counts + ["searchable"] * spec.searchable
            line = f"{label}({props})" + (f" [{', '.join(tail)}]" if tail else "")
            if samples and (keys := [r["key"] for r in self.sample_keys(label).collect()]):
                line += " samples: " + ", ".join(json.dumps(k, ensure_ascii=False) for k in keys)
            lines.append(line)
        for name in sorted(self.visible_rels()):
            rel = self.rel_specs[name]
            props = "".join(f", {p}:{t}" for p, t in rel.properties.items() if not p.startswith("_"))
            lines.append(f"{name}({rel.source} -> {rel.target}{props})" + (f" [{self.rels[name].count()} rows]" if counts else ""))
        return "\n".join(lines)


def node_id(label: str, key):
    return F.concat(F.lit(label + ":"), key.cast("string"))


_NAMES = {"bigint": "INT64", "int": "INT64", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOL", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "string": "STRING"}


def type_name(simple: str) -> str:
    return _NAMES.get(simple, simple)
