"""A property graph over a folder of relational Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph


_opened: dict[tuple[str, str], Graph] = {}


def table_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph of a folder: opened once in a session, as its tables are read-only; each caller gets a catalog of its own to add to."""
    place = (spark.sparkContext.applicationId, folder)
    if place not in _opened:
        if len(_opened) >= 8:
            _opened.clear()
        _opened[place] = _open(spark, folder)
    return _opened[place].copy()


def _open(spark: SparkSession, folder: str) -> Graph:
    """Region, Nation, Customer, Supplier, Part, Order, Doc, Label and Turn nodes and the relationships that foreign keys imply."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    lines, docs = read("lineitem"), read("documents")
    graph = Graph()
    graph.add_nodes("Region", read("region"), "r_regionkey")
    graph.add_nodes("Nation", read("nation"), "n_nationkey")
    graph.add_nodes("Customer", read("customer"), "c_custkey")
    graph.add_nodes("Supplier", read("supplier"), "s_suppkey")
    graph.add_nodes("Part", read("part"), "p_partkey")
    graph.add_nodes("Order", read("orders"), "o_orderkey")
    graph.add_nodes("Doc", docs, "doc_id", searchable=True)
    graph.add_nodes("Label", read("labels").withColumnRenamed("doc_id", "label_doc"), "label_doc")
    graph.add_rels("IN_REGION", read("nation").select(F.col("n_nationkey").alias("_src"), F.col("n_regionkey").alias("_dst")), "Nation", "Region")
    graph.add_rels("LIVES_IN", read("customer").select(F.col("c_custkey").alias("_src"), F.col("c_nationkey").alias("_dst")), "Customer", "Nation")
    graph.add_rels("BASED_IN", read("supplier").select(F.col("s_suppkey").alias("_src"), F.col("s_nationkey").alias("_dst")), "Supplier", "Nation")
    graph.add_rels("PLACED", read("orders").select(F.col("o_custkey").alias("_src"), F.col("o_orderkey").alias("_dst")), "Customer", "Order")
    item = [F.col("l_orderkey").alias("_src")]
    props = [F.col(f"l_{p}").alias(p) for p in ("quantity", "extendedprice", "discount", "shipdate")]
    graph.add_rels("HAS_PART", lines.select(*item, F.col("l_partkey").alias("_dst"), *props), "Order", "Part")
    graph.add_rels("SUPPLIED_BY", lines.select(*item, F.col("l_suppkey").alias("_dst"), *props), "Order", "Supplier")
    graph.add_rels("HAS_LABEL", read("labels").select(F.col("doc_id").alias("_src"), F.col("doc_id").alias("_dst")), "Doc", "Label")
    turns = read("conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("turn_id"), "conv_id", "turn", "role", "text")
    graph.add_nodes("Turn", turns, "turn_id")
    following = turns.select((F.col("turn_id") - 1).alias("_src"), F.col("turn_id").alias("_dst")).where(F.col("turn") > 0)
    graph.add_rels("NEXT_TURN", following.join(turns.select(F.col("turn_id").alias("_src")), "_src", "left_semi"), "Turn", "Turn")
    return graph
