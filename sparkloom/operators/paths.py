"""Shortest paths between given ends, searched from both of them.

Each side holds levels (``anchor``, ``node``): the nodes whose distance from their anchor, a start or a goal, is exactly the level's number. The side
with fewer rows grows by one edge, or, where both have about as many, the one with fewer edges at its nodes; a pair whose last levels meet in a node has as its distance the sum of both depths, unless it was found before. So
each side goes half of the way, and holds the half paths only. Anchors of which every pair is found grow no further.

Levels are written to the session's shared folder: executors may be lost, and Spark knows their size, so that a small level is broadcast to the edges
and a large one shuffled with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder

_RELS, _NODES, _WALKS = "rels", "nodes", "walks"
#: The edges at both sides' levels are counted where neither has so many times the other's rows.
CLOSE = 2


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class _Side:
    """Levels from one end of the paths. ``paths``: None, which of the half paths to an equal node are kept, "one" or "all", or "count": how many there are."""

    def __init__(self, name: str, anchors: DataFrame, forward: bool, paths: str | None, point: Callable[[Column], Column] | None, edge_type: str | None):
        self.name, self.forward, self.point, self.counted = name, forward, point, paths == "count"
        self.paths = None if self.counted else paths
        level = anchors.select(F.col(name).alias("anchor")).distinct().withColumn("node", F.col("anchor"))
        if self.counted:
            level = level.withColumn(_WALKS, F.lit(1).cast("long"))
        if self.paths:
            # a path's first node belongs to the side of the starts
            nodes = F.array(point(F.col("anchor")))
            level = level.withColumn(_RELS, F.array().cast(f"array<{edge_type}>")).withColumn(_NODES, nodes if forward else F.slice(nodes, 1, 0))
        self.level = written(level)
        self.seen = self.level.select("anchor", "node")
        self.size = self.anchors = self.level.count()

    def pending(self, pairs: DataFrame | None, done: DataFrame | None, others: int) -> DataFrame:
        """The last level without anchors of which every pair is found: those in none of the open ``pairs``, else those ``done`` with all ``others``."""
        if done is None:
            return self.level
        if pairs is not None:
            return self.level.join(pairs.select(F.col(self.name).alias("anchor")).distinct(), "anchor", "left_semi")
        finished = done.groupBy(F.col(self.name).alias("anchor")).count().where(F.col("count") >= others)
        return self.level.join(finished, "anchor", "left_anti")

    def ahead(self, edges: DataFrame) -> int:
        """How many edges begin at the rows of the last level."""
        here = "__from" if self.forward else "__to"
        nodes = self.level.groupBy("node").agg(F.count("*").alias("n"))
        return nodes.join(edges.select(here), F.col("node") == F.col(here)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def grow(self, level: DataFrame, edges: DataFrame) -> None:
        here, there = ("__from", "__to") if self.forward else ("__to", "__from")
        step = level.join(edges, F.col("node") == F.col(here))
        names = ["anchor", F.col(there).alias("node")]
        if self.paths:
            edge, point = F.array("__edge"), F.array(self.point(F.col("__to")))
            halves = ((_RELS, edge), (_NODES, point))
            names += [(F.concat(c, one) if self.forward else F.concat(one, c)).alias(c) for c, one in halves]
        step = step.select(*names, *[_WALKS] * self.counted)
        if self.counted:
            step = step.groupBy("anchor", "node").agg(F.sum(_WALKS).alias(_WALKS))
        elif not self.paths:
            step = step.distinct()
        step = step.join(self.seen, ["anchor", "node"], "left_anti")
        if self.paths == "one":
            step = _least(step, "anchor", "node")
        self.level = written(step)
        self.seen = self.seen.union(self.level.select("anchor", "node").distinct() if self.paths == "all" else self.level.select("anchor", "node"))
        self.size = self.level.count()

    def named(self, node: str) -> DataFrame:
        """The last level with names of its own."""
        return self.level.select(F.col("anchor").alias(f"__{self.name}"), F.col("node").alias(node), *[F.col(c).alias(f"__{self.name}_{c}") for c in ((_RELS, _NODES) if self.paths else (_WALKS,) * self.counted)])


def _least(df: DataFrame, *by: str) -> DataFrame:
    least = df.groupBy(*by).agg(F.min(F.struct(_RELS, _NODES)).alias("__least"))
    return least.select(*by, F.col(f"__least.{_RELS}").alias(_RELS), F.col(f"__least.{_NODES}").alias(_NODES))


def shortest_between(edges: DataFrame, low: int, high: int, pairs: DataFrame | None = None, starts: DataFrame | None = None, goals: DataFrame | None = None, paths: str | None = None, point: Callable[[Column], Column] | None = None) -> tuple[DataFrame, bool]:
    """``start``, ``goal``, ``hops`` of the pairs between ``low`` and ``high`` edges apart; with ``paths`` also ``rels`` and ``nodes`` of "one" (the least) or "all" of the shortest paths, or, as "count", their number ``walks``.

    edges: ``__from``, ``__to``, with "one" or "all" ``paths`` also ``__edge``, a struct; ``point`` makes what stands for a node in a path. Asked are the ``pairs`` (``start``, ``goal``), or each of the
    ``starts`` with each of the ``goals``: these are never joined with each other, but where their levels meet. A start is its own goal at no edge only.
    Repeated pairs count once. The second value says whether the search ended by itself, because every pair was found or a side had no way to go on.
    """
    edge_type = dict(edges.dtypes).get("__edge")
    if pairs is not None:
        pairs = written(pairs.select("start", "goal").distinct())
        starts = goals = pairs
    forward = _Side("start", starts, True, paths, point, edge_type)
    backward = _Side("goal", goals, False, paths, point, edge_type)
    asked = pairs.count() if pairs is not None else forward.size * backward.size
    found, done = None, None
    for hops in range(high + 1):
        if hops:
            side, other = (forward, backward) if _first(forward, backward, edges, hops, high) else (backward, forward)
            side.grow(side.pending(pairs, done, other.anchors), edges)
        met = written(_meetings(forward, backward, pairs, done, paths).withColumn("hops", F.lit(hops)))
        ends = met.select("start", "goal").distinct() if paths == "all" else met.select("start", "goal")
        number = ends.count()
        if hops >= low and (number or found is None):
            found = met if found is None else found.unionByName(met)
        if number:
            asked -= number
            done = ends if done is None else done.union(ends)
            if pairs is not None and asked:
                pairs = written(pairs.join(ends, ["start", "goal"], "left_anti"))
        if not asked or not forward.size or not backward.size:
            return (met.limit(0) if found is None else found), True
    return (met.limit(0) if found is None else found), False


def _first(forward: _Side, backward: _Side, edges: DataFrame, hops: int, high: int) -> bool:
    """Whether the forward side is the one to grow. Of a path's first edge and of one without a bound the rows decide, as they say enough."""
    few, many = sorted((forward.size, backward.size))
    if hops == 1 or high > 8 or many >= CLOSE * few:
        return forward.size <= backward.size
    return forward.ahead(edges) <= backward.ahead(edges)


def _meetings(forward: _Side, backward: _Side, pairs: DataFrame | None, done: DataFrame | None, paths: str | None) -> DataFrame:
    """The pairs not found yet whose last levels share a node."""
    small, large = (forward, backward) if forward.size <= backward.size else (backward, forward)
    left, right = small.named("__mid"), large.named("__node")
    if pairs is None:
        met = left.join(right, F.col("__mid") == F.col("__node"))
    else:
        # a pair is followed by the nodes of its smaller side
        asked = pairs.join(left, pairs[small.name] == left[f"__{small.name}"])
        met = asked.join(right, (asked[large.name] == right[f"__{large.name}"]) & (F.col("__mid") == F.col("__node")))
    joined = [F.concat(F.col(f"__start_{c}"), F.col(f"__goal_{c}")).alias(c) for c in (_RELS, _NODES)] if paths in ("one", "all") else []
    if paths == "count":
        met = met.groupBy(F.col("__start").alias("start"), F.col("__goal").alias("goal")).agg(F.sum(F.col(f"__start_{_WALKS}") * F.col(f"__goal_{_WALKS}")).alias(_WALKS))
    else:
        met = met.select(F.col("__start").alias("start"), F.col("__goal").alias("goal"), *joined)
    if not paths:
        met = met.distinct()
    if pairs is None and done is not None:
        met = met.join(done, ["start", "goal"], "left_anti")
    return _least(met, "start", "goal") if paths == "one" else met
