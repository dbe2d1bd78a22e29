"""Stored neighbour lists: of each node its edges of all types, in both directions, in folders by a hash of the node.

A level of an expansion reads the folders of its nodes only, and of their files the pages within the range of its ids; edges are not shuffled. Lists
are sorted by node; a node with more than LIST edges has several, dealt by a hash of the neighbour, which SPREAD tasks write.

Over a store the lists are kept for a state of its relationship tables. What the tables' deltas changed since then is laid over them on read; a quarter
of all edges, a replaced or compacted table, or a new type, and the lists are written anew.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import node_id
from ..store import DELETED, GraphStore, create_file
from .paths import written
from .segments import newest_state

LIST = 1024
#: Folders: one for so many list entries, and a bound, as a level's folders are named on the driver.
ENTRIES_A_BUCKET, MOST_BUCKETS = 8_000_000, 4096
SPREAD = 16
#: So many hubs are broadcast; more are joined by a shuffle.
BROADCAST_HUBS = 200_000
#: Changes beyond this share of the edges are not laid over the lists any more.
MOST_CHANGES = 0.25

_LISTS = "node string, chunk long, near array<struct<type:string,out:boolean,other:string>>, bucket int"


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def write_lists(edges: DataFrame, folder: str, buckets: int | None = None, longest: int = LIST) -> dict:
    """Write the lists of ``type``, ``src``, ``dst``, canonical ids; what must be remembered of them. Repeated edges count once, edges without an end not at all."""
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    ends = edges.select(F.col("src").alias("node"), "type", F.lit(True).alias("out"), F.col("dst").alias("other"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), "type", F.lit(False).alias("out"), F.col("src").alias("other")))
    counted = ends.groupBy("node").count().where(F.col("count") > longest)
    # hubs are few, and written so that Spark knows it: the ends themselves are not shuffled to meet them
    hubs = written(counted.select(F.col("node").alias("hub"), F.ceil(F.col("count") / longest).alias("chunks")))
    number = edges.count()
    buckets = buckets or max(1, min(MOST_BUCKETS, math.ceil(2 * number / ENTRIES_A_BUCKET)))
    few = F.broadcast(hubs) if hubs.count() <= BROADCAST_HUBS else hubs
    dealt = ends.join(few, F.col("node") == F.col("hub"), "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("type", "out", "other"), F.col("chunks")), F.lit(0)))
    lists = dealt.groupBy("node", "chunk").agg(F.collect_set(F.struct("type", "out", "other")).alias("near")).withColumn("bucket", _bucket(F.col("node"), buckets))
    lists.repartition(F.col("bucket"), F.pmod("chunk", F.lit(SPREAD))).sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(folder)
    return {"folder": folder, "buckets": buckets, "edges": number}


class Adjacency:
    """Neighbour lists as :func:`write_lists` left them, with later ``changes`` (``type``, ``src``, ``dst``, ``_deleted``), one row an edge."""

    def __init__(self, spark: SparkSession, state: dict, changes: DataFrame | None = None):
        self.spark, self.state, self.changes = spark, state, changes

    def lists(self, frontier: DataFrame) -> DataFrame:
        """The lists of the folders, and within the ids, of a frontier (``node_id``)."""
        where = frontier.agg(F.collect_set(_bucket(F.col("node_id"), self.state["buckets"])).alias("buckets"), F.min("node_id").alias("low"), F.max("node_id").alias("high")).first()
        return self.spark.read.schema(_LISTS).parquet(self.state["folder"]).where(F.col("bucket").isin(where["buckets"]) & F.col("node").between(F.lit(where["low"]), F.lit(where["high"])))

    def edges_at(self, frontier: DataFrame) -> DataFrame:
        """``type``, ``src``, ``dst`` of all edges with an end in the frontier."""
        near = frontier.select("node_id").distinct()
        rows = self.lists(near).join(near, F.col("node") == F.col("node_id"), "left_semi").select("node", F.explode("near").alias("e"))
        met = rows.select("e.type", F.when(F.col("e.out"), F.col("node")).otherwise(F.col("e.other")).alias("src"), F.when(F.col("e.out"), F.col("e.other")).otherwise(F.col("node")).alias("dst"))
        if self.changes is None:
            return met
        late = self.changes.where(~F.col(DELETED)).select("type", "src", "dst")
        ends = [late.join(near, late[end] == near["node_id"], "left_semi") for end in ("src", "dst")]
        return met.join(self.changes.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti").unionByName(ends[0]).unionByName(ends[1])


def _late(store: GraphStore, state: dict | None) -> tuple[bool, list[tuple[str, list[dict]]]]:
    """Whether the lists of a state, with the deltas that are returned, make up the store's relationships."""
    names = store.graph().visible_rels()
    if state is None or sorted(state["tables"]) != sorted(names):
        return False, []
    out = []
    for name in names:
        entry, known = store.entry(name), state["tables"][name]
        late = [d for d in entry.get("deltas", []) if d["seq"] >= known["upto"]]
        if entry.get("epoch", 0) != known["epoch"] or len(late) != entry.get("next", 0) - known["upto"]:
            return False, []
        if late:
            out.append((name, late))
    return True, out


def _changes(store: GraphStore, late: list[tuple[str, list[dict]]]) -> DataFrame | None:
    graph, parts = store.graph(), []
    for name, deltas in late:
        spec = graph.rel_specs[name]
        parts.append(store.changes(name, deltas).select(F.lit(name).alias("type"), node_id(spec.source, F.col("_src")).alias("src"), node_id(spec.target, F.col("_dst")).alias("dst"), DELETED))
    return reduce(DataFrame.unionByName, parts) if parts else None


def adjacency_of(store: GraphStore, make: bool = True) -> Adjacency | None:
    """The lists of a store's relationships as it sees them now, written where they are missing or too old; None if it has none, or without ``make`` no usable ones."""
    if not store.graph().visible_rels():
        return None
    root = f"{store.path}/indexes/adjacency"
    number, state = newest_state(store.spark, root)
    fits, late = _late(store, state)
    changes = _changes(store, late)
    if fits and (changes is None or not make or changes.count() <= MOST_CHANGES * state["edges"]):
        return Adjacency(store.spark, state, changes)
    if not make:
        return None
    tables = {name: {"epoch": store.entry(name).get("epoch", 0), "upto": store.entry(name).get("next", 0)} for name in store.graph().visible_rels()}
    made = write_lists(store.graph().edges(), f"{root}/{uuid.uuid4().hex}") | {"tables": tables}
    # of several writers the first publishes; a reader of an earlier version, or a later writer, keeps what it made for itself
    if state is None or all(tables[n]["epoch"] >= t["epoch"] and tables[n]["upto"] >= t["upto"] for n, t in state["tables"].items() if n in tables):
        create_file(store.spark, f"{root}/state/v{number + 1:08d}.json", json.dumps(made))
    return Adjacency(store.spark, made)
