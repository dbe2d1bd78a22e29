import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.catalog import Graph
from sparkloom.errors import ConfigurationError, CypherError, NotFoundError, ReadOnlyViolation, SchemaError
from sparkloom.functions import polar, vectors
from sparkloom.operators import chunk, codegraph, mutate, pack, retrieve
from sparkloom.plans.compiler import cypher
from sparkloom.plans.parser import check_read_only, parse
from sparkloom.sources.transfer import export_graph, import_graph


@pytest.fixture(scope="module")
def people(spark):
    graph = Graph()
    graph.add_nodes("Person", spark.createDataFrame([("a", "Ann", 40), ("b", "Bob", None), ("c", "Cid", 7)], "id string, name string, age long"), "id", searchable=True)
    graph.add_nodes("Team", spark.createDataFrame([("t", "Tea")], "id string, name string"), "id")
    graph.add_rels("KNOWS", spark.createDataFrame([("a", "b", 2024), ("b", "c", 2025), ("c", "c", 1)], "_src string, _dst string, since long"), "Person", "Person")
    graph.add_rels("MEMBER_OF", spark.createDataFrame([("a", "t")], "_src string, _dst string"), "Person", "Team")
    return graph


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_patterns(people):
    assert got(cypher(people, "MATCH (a:Person)-[r:KNOWS]->(b) WHERE r.since > 2000 RETURN a.name, b.name")) == [("Ann", "Bob"), ("Bob", "Cid")]
    # a self-loop counts once without direction
    assert got(cypher(people, "MATCH (a:Person {id: 'c'})-[r:KNOWS]-(b) RETURN b.id AS b")) == [("b",), ("c",)]
    assert got(cypher(people, "MATCH p = shortestPath((a:Person {id: 'a'})-[:KNOWS*..3]->(b:Person {id: 'c'})) RETURN length(p) AS n")) == [(2,)]
    assert got(cypher(people, "MATCH (a)-[:MEMBER_OF]->(t) RETURN a.id AS a, label(t) AS l")) == [("a", "Team")]


def test_nulls_and_order(people):
    down = cypher(people, "MATCH (p:Person) RETURN p.id AS i ORDER BY p.age DESC").collect()
    assert [r["i"] for r in down] == ["b", "a", "c"]
    up = cypher(people, "MATCH (p:Person) RETURN p.id AS i ORDER BY p.age").collect()
    assert [r["i"] for r in up] == ["c", "a", "b"]


def test_whole_nodes_and_parameters(people):
    row = cypher(people, "MATCH (p:Person) WHERE p.id = $id RETURN p", {"id": "a"}).first()["p"]
    assert row["_id"] == "Person:a" and row["name"] == "Ann"
    with pytest.raises(CypherError):
        cypher(people, "MATCH (p:Person) WHERE p.id = $id RETURN p")


@pytest.mark.parametrize("text", ["CREATE (n:X)", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) DETACH DELETE n", "CALL DROP_VECTOR_INDEX('a') RETURN *"])
def test_writes_are_rejected(text):
    with pytest.raises(ReadOnlyViolation):
        check_read_only(text)


def test_words_in_literals_are_allowed():
    check_read_only("MATCH (n) WHERE n.x = 'DELETE' // CREATE\n RETURN n")


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "RETURN", "MATCH (n) RETURN n n", "FOO"])
def test_bad_syntax(text):
    with pytest.raises(CypherError):
        parse(text)


def test_unknown_names(people):
    with pytest.raises(SchemaError):
        cypher(people, "MATCH (n:Nobody) RETURN n")
    with pytest.raises(SchemaError):
        cypher(people, "MATCH (a)-[:HATES]->(b) RETURN a")


def test_describe(people):
    text = people.describe_text()
    assert 'Person(id:STRING PK, name:STRING, age:INT64) [3 rows, searchable] samples: "a", "b", "c"' in text
    assert "KNOWS(Person -> Person, since:INT64) [3 rows]" in text


def test_export_import(spark, people, tmp_path):
    export_graph(people, str(tmp_path / "out"))
    again, warnings = import_graph(spark, str(tmp_path / "out"))
    assert warnings.count() == 0
    for label in people.nodes:
        assert got(again.nodes[label].select(people.nodes[label].columns)) == got(people.nodes[label])
    assert got(again.rels["KNOWS"].select("_src", "_dst", "since")) == got(people.rels["KNOWS"])


def test_import_warnings(spark, tmp_path):
    lines = [{"type": "graph_export", "format_version": 1}, {"type": "schema", "node_tables": [{"name": "P", "key": "id", "key_type": "STRING", "properties": {}, "searchable": False}], "rel_tables": [{"name": "R", "from": "P", "to": "P", "properties": {}}]}]
    lines += [{"type": "node", "label": "P", "key": "x"}, {"type": "edge", "rel": "R", "from": "P:x", "to": "P:y"}, {"type": "odd"}]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    graph, warnings = import_graph(spark, str(tmp_path / "f.jsonl"))
    assert graph.rels["R"].count() == 0 and sorted(r["warning"] for r in warnings.collect()) == ["missing end", "unknown kind"]


def test_upsert(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n long, s string")
    batch = spark.createDataFrame([("a", None, "z", 0), ("c", 5, None, 1), ("c", 6, None, 2), ("c", None, "w", 3)], "id string, n long, s string, _ordinal int")
    assert got(mutate.upsert(table, batch, ["id"])) == [("a", 1, "z"), ("b", 2, "y"), ("c", 6, "w")]
    assert got(mutate.upsert(table, batch.limit(0), ["id"])) == got(table)


def test_edges_need_ends(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    table = spark.createDataFrame([], "_src string, _dst string, w long")
    good = spark.createDataFrame([("a", "b", 1, 0), ("a", "b", 2, 1)], "_src string, _dst string, w long, _ordinal int")
    assert got(mutate.upsert_edges(table, good, nodes, "id", nodes, "id")) == [("a", "b", 2)]
    with pytest.raises(NotFoundError):
        mutate.upsert_edges(table, good.withColumn("_dst", F.lit("q")), nodes, "id", nodes, "id")


def test_prune(spark):
    table = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, None)], "id long, _source string")
    kept, gone = mutate.prune(table, table.where("id = 1"), "id", "s")
    assert got(gone) == [(2, "s")] and kept.count() == 3


def test_pack_skips_long_lines():
    text, cut = pack.pack(["aaaa" * 3, "b" * 400, "cc"], 10)
    assert text == "aaaaaaaaaaaa\ncc" and cut
    assert pack.pack(["a"], -1) == ("", True)
    assert pack.node_line("P:1", {"a": "x" * 300, "b": None, "_source": "s"}).endswith('xxx..."} [source: s]')


def test_chunks():
    assert chunk.split_text("  ") == []
    assert chunk.split_text("One. Two.\n\nThree.", 100) == ["One. Two.\n\nThree."]
    parts = chunk.split_text("Alpha beta gamma. " * 40, 100, 20)
    assert all(len(p) <= 100 for p in parts) and len(parts) > 5
    assert all(len(p) <= 10 for p in chunk.split_text("x" * 95, 10, 3))


def test_code_resolution(spark):
    files = spark.createDataFrame([("p/a.py", "def f():\n    return g()\n\ndef g():\n    return f()\n"), ("p/b.py", "from p.a import f\nclass A:\n    def m(self):\n        self.n(); f()\n    def n(self): pass\n"), ("p/bad.py", "def (")], "path string, source string")
    nodes, edges = codegraph.code_graph(files)
    calls = got(edges.where("type = 'CALLS'").select("src", "dst"))
    assert calls == [("repo:p/a.py#f", "repo:p/a.py#g"), ("repo:p/a.py#g", "repo:p/a.py#f"), ("repo:p/b.py#A.m", "repo:p/a.py#f"), ("repo:p/b.py#A.m", "repo:p/b.py#A.n")]
    assert got(edges.where("type = 'IMPORTS'").select("src", "dst")) == [("repo:p/b.py", "repo:p/a.py")]
    assert nodes.where("kind = 'Module'").count() == 2


def test_polar():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(200, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert np.allclose(polar.from_angles(polar.to_angles(unit)), unit, atol=1e-9)
    blobs = polar.encode(unit, 4.0)
    assert len(blobs[0]) == 6 + 32
    cosine = (polar.decode(blobs) * unit).sum(1)
    assert cosine.mean() > 0.95 and cosine.min() > 0.9
    with pytest.raises(ConfigurationError):
        polar.encode(unit * 2, 4.0)


def test_codec_search_agrees(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    query = [float(x) for x in table.where("vec_id = 3").first()["embedding"]]
    exact, coded = ([r["key"] for r in vectors.top_k(table, "vec_id", "embedding", query, 10, c).collect()] for c in ("fp32", "int8"))
    assert exact[0] == 3 and len(set(exact) & set(coded)) >= 9


def test_search(people):
    found = retrieve.search(people, "ann", hops=1)
    assert [r["node_id"] for r in found.seeds.collect()] == ["Person:a"] and found.vector_status == "off"
    assert {r["node_id"] for r in found.nodes.collect()} == {"Person:a", "Person:b", "Team:t"}
    assert retrieve.search(people, " ").seeds.count() == 0


def test_bare_keys(people):
    assert got(retrieve.resolve_keys(people, ["t", "Person:a"])) == [("Person:a",), ("Team:t",)]
    with pytest.raises(SchemaError):
        retrieve.resolve_keys(people, ["nobody"])


@pytest.mark.parametrize("op", ["<", ">", "<=", ">="])
def test_pairs_of_a_comparison_are_counted_without_being_made(spark, op):
    import random

    from sparkloom.catalog import Graph

    rng = random.Random(5)
    value = lambda: rng.choice([None, -0.0, 0.0, float("nan"), *[float(rng.randrange(40)) for _ in range(8)]])
    buyers = [(k, k % 3, value(), "even" if k % 2 == 0 else None) for k in range(300)]
    sellers = [(k, k % 4, value()) for k in range(90)]
    graph = Graph()
    graph.add_nodes("Town", spark.createDataFrame([(k,) for k in range(4)], "id long"), "id")
    graph.add_nodes("Buyer", spark.createDataFrame(buyers, "id long, town long, x double, kind string"), "id")
    graph.add_nodes("Seller", spark.createDataFrame(sellers, "id long, town long, y double"), "id")
    graph.add_rels("LIVES", graph.nodes["Buyer"].select(F.col("id").alias("_src"), F.col("town").alias("_dst")), "Buyer", "Town")
    graph.add_rels("SELLS", graph.nodes["Seller"].select(F.col("id").alias("_src"), F.col("town").alias("_dst")), "Seller", "Town")
    text = f"MATCH (b:Buyer)-[:LIVES]->(t:Town), (s:Seller)-[:SELLS]->(t) WHERE b.x {op} s.y RETURN b.kind AS kind, count(*) AS n"
    got = cypher(graph, text)
    pairs = graph.nodes["Buyer"].alias("b").join(graph.nodes["Seller"].alias("s"), "town").where(f"b.x {op} s.y")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in pairs.groupBy("b.kind").count().collect()}
    assert cypher(graph, text.replace("b.kind AS kind, ", "")).first()["n"] == pairs.count()
    assert "Window" in got._jdf.queryExecution().optimizedPlan().toString()
