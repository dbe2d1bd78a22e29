"""Connected components of links, by repeated contraction.

In each round every node joins the neighbour (or itself) that comes first in a pseudo-random order of the round,
and links between nodes that joined the same one vanish. A constant share of the nodes goes in each round, stars
go in two, and a node with a third of all links only meets partial minima and joins, never one task's list.
Once no more than FINAL_LINKS links are left, a task with memory for just so many finishes them by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import checkpoint

FINAL_LINKS = 100_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents: dict = {}

    def find(x):
        while (up := parents.setdefault(x, x)) != x:
            parents[x] = x = parents.setdefault(up, up)
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parents[max(a, b)] = min(a, b)
    if parents:
        nodes = list(parents)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["old", "new"])


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns ``a``, ``b``. Gives ``node``, ``root`` for each node with a link to another node."""
    conf, key = links.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # constraints would pile up from round to round
    try:
        return _contract(links)
    finally:
        conf.set(key, before)


def _contract(links: DataFrame) -> DataFrame:
    kind = links.schema["a"].dataType.simpleString()
    edges = checkpoint(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    out = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    number = 0
    while left := edges.count():
        if left <= FINAL_LINKS:
            joined, edges = map_arrow(edges.repartition(1), _union_find, f"old {kind}, new {kind}"), edges.limit(0)
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), c.alias("id"))  # noqa: B023, E731
            best = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
            joined = checkpoint(best.select(F.col("a").alias("old"), F.least(F.col("best"), rank(F.col("a")))["id"].alias("new")))
            ends = [joined.select(F.col("old").alias(c), F.col("new").alias(f"n{c}")) for c in "ab"]
            edges = checkpoint(edges.join(ends[0], "a").join(ends[1], "b").where("na != nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        out = checkpoint(out.join(joined, out["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root")))
        number += 1
    return out
