"""Shortest paths from both ends against breadth-first searches by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.catalog import Graph
from sparkloom.operators.paths import shortest_between
from sparkloom.plans.compiler import cypher


def all_paths(edges, start, high):
    """Per node its distance and the shortest paths, as lists of edges."""
    out = defaultdict(list)
    for e in edges:
        out[e[0]].append(e)
    best, level = {start: (0, [()])}, {start: [()]}
    for depth in range(1, high + 1):
        nxt = defaultdict(list)
        for node, paths in level.items():
            for e in out[node]:
                if e[1] not in best:
                    nxt[e[1]] += [(*p, e[2]) for p in paths]
        best |= {n: (depth, p) for n, p in nxt.items()}
        level = nxt
    return best


def sample(seed, nodes=14, count=26):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.randrange(nodes), k) for k in range(count)]


@pytest.mark.parametrize(("seed", "paths", "low"), [(1, None, 0), (2, "all", 1), (3, "one", 2)])
def test_from_both_ends(spark, seed, paths, low):
    edges = sample(seed)
    given = spark.createDataFrame(edges, "__from long, __to long, e long").withColumn("__edge", F.struct("e")).drop("e")
    asked = [(s, g) for s in range(0, 14, 2) for g in range(0, 14, 3)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    ways = [{"pairs": frame(asked[::2] + asked[:3], ("start", "goal"))}, {"starts": frame([(s,) for s in range(0, 14, 2)] * 2, ("start",)), "goals": frame([(g,) for g in range(0, 14, 3)], ("goal",))}]
    for way, pairs in zip(ways, (set(asked[::2] + asked[:3]), set(asked)), strict=True):
        found, _ = shortest_between(given, low, 4, paths=paths, point=lambda c: c, **way)
        want = []
        for s, g in pairs:
            hops, lists = all_paths(edges, s, 4).get(g, (None, []))
            if hops is not None and hops >= low:
                lists = [None] if paths is None else [min(lists)] if paths == "one" else lists
                want += [(s, g, hops, p) for p in lists]
        got = [(r["start"], r["goal"], r["hops"], tuple(x["e"] for x in r["rels"]) if paths else None) for r in found.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        if paths:
            ends = {k: (a, b) for a, b, k in edges}
            for r in found.collect():
                assert r["nodes"] == [r["start"], *(ends[x["e"]][1] for x in r["rels"])]


@pytest.fixture(scope="module")
def roads(spark):
    graph = Graph()
    graph.add_nodes("Town", spark.range(12).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4).alias("zone")), "id")
    graph.add_nodes("Inn", spark.createDataFrame([("x", 1), ("y", 2)], "id string, zone long"), "id")
    roads = [(str(k), str(k + 1)) for k in range(9)] + [("0", "4"), ("3", "3")]
    graph.add_rels("ROAD", spark.createDataFrame(roads, "_src string, _dst string"), "Town", "Town")
    graph.add_rels("IN", spark.createDataFrame([("x", "2"), ("y", "8")], "_src string, _dst string"), "Inn", "Town")
    return graph


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH p = shortestPath((a:Town {id: '0'})-[:ROAD*]->(b:Town {id: '7'})) RETURN length(p) AS n", [(4,)]),
        ("MATCH p = shortestPath((a:Town {id: '7'})-[:ROAD*..9]->(b:Town {id: '0'})) RETURN length(p) AS n", []),
        ("MATCH (a:Town {id: '6'}), (b:Town {id: '1'}) MATCH p = shortestPath((a)-[:ROAD*]-(b)) RETURN length(p) AS n, nodes(p)[3]._id AS v", [(4, "Town:0")]),
        ("MATCH (a:Inn), (b:Inn) WHERE a.id < b.id MATCH p = shortestPath((a)-[*..8]-(b)) RETURN a.id AS a, b.id AS b, length(p) AS n", [("x", "y", 8)]),
        ("MATCH p = allShortestPaths((a:Inn {id: 'x'})-[*..8]-(b:Inn {zone: 2})) RETURN length(p) AS n", [(8,)]),
        ("MATCH (a:Town {id: '3'}), (b:Town {id: '3'}) MATCH (a)-[:ROAD* SHORTEST 0..3]-(b) RETURN a.id AS a", [("3",)]),
        ("MATCH (a:Town {id: '3'}), (b:Town {id: '3'}) MATCH (a)-[:ROAD* SHORTEST 1..3]-(b) RETURN a.id AS a", []),
        ("MATCH (a:Town {id: '10'}) MATCH p = shortestPath((a)-[:ROAD*]-(b:Town {zone: 0})) RETURN b.id AS b", []),
    ],
)
def test_queries(roads, text, want):
    assert sorted(tuple(r) for r in cypher(roads, text).collect()) == want


def test_paths_are_counted(spark):
    """Only the number of the shortest paths is held, for each pair and level, with parallel edges and both ways of asking."""
    edges = [(0, b, b) for b in range(1, 5)] * 3 + [(b, 9, 10 + b) for b in range(1, 5)] * 2 + [(9, 11, 30), (0, 11, 31), (11, 12, 32)]
    given = spark.createDataFrame([e[:2] for e in edges], "__from long, __to long")
    starts, goals = spark.createDataFrame([(0,), (1,)], "start long"), spark.createDataFrame([(g,) for g in (0, 3, 9, 11, 12)], "goal long")
    want = sorted((s, g, n[0], len(n[1])) for s in (0, 1) for g in (0, 3, 9, 11, 12) if (n := all_paths(edges, s, 4).get(g)))
    for way in ({"starts": starts, "goals": goals}, {"pairs": starts.crossJoin(goals)}):
        found, _ = shortest_between(given, 0, 4, paths="count", **way)
        assert sorted(map(tuple, found.select("start", "goal", "hops", "walks").collect())) == want


def test_queries_count_paths(spark, monkeypatch):
    """A query that asks for the length and the number of shortest paths lists none, whether its ends are known or not; one that asks for their nodes does."""
    from sparkloom.plans import compiler

    graph = Graph()
    graph.add_nodes("Town", spark.range(6).select("id", (F.col("id") % 2).alias("zone")), "id")
    graph.add_rels("ROAD", spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 3), (2, 3), (3, 5)], "_src long, _dst long"), "Town", "Town")
    listed = []
    kept = compiler.Compiler.join_hops
    monkeypatch.setattr(compiler.Compiler, "join_hops", lambda self, *args: (listed.append(args[5]), kept(self, *args))[1])
    part = "MATCH p = allShortestPaths((a:Town {id: 0})-[:ROAD*..4]->(b:Town%s)) RETURN b.id AS b, length(p) AS n, count(*) AS paths"
    for limited, ends in (("", (1, 2, 3, 5)), (" {zone: 1}", (1, 3, 5))):
        found = [(r.b, r.n, r.paths) for r in cypher(graph, part % limited + " ORDER BY b").collect()]
        assert found == [x for x in [(1, 1, 1), (2, 1, 2), (3, 2, 3), (5, 3, 3)] if x[0] in ends]
    assert listed == [False, False]
    text = (part % " {zone: 1}").replace("length(p) AS n", "nodes(p)[1]._id AS via")
    assert sorted(map(tuple, cypher(graph, text).collect())) == [(1, "Town:1", 1), (3, "Town:1", 1), (3, "Town:2", 2), (5, "Town:1", 1), (5, "Town:2", 2)]
    assert listed == [False, False, True]
