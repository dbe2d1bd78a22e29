import pytest

from sparkloom.catalog import NodeTable, RelTable
from sparkloom.errors import ReadOnlyViolation, SchemaError
from sparkloom.service import GraphService
from sparkloom.store import GraphStore


def test_store_and_service(spark, tmp_path):
    service = GraphService(GraphStore(spark, str(tmp_path)))
    service.define_schema([NodeTable("Person", "name", {"age": "INT64", "note": "STRING"}, True)], [RelTable("KNOWS", "Person", "Person", {"since": "INT64"})])
    service.upsert_nodes("Person", spark.createDataFrame([("Ann", 40, "likes tea"), ("Bob", 50, "likes rust")], "name string, age long, note string"))
    service.upsert_edges("KNOWS", spark.createDataFrame([("Ann", "Bob", 2020)], "_src string, _dst string, since long"))
    service.upsert_nodes("Person", spark.createDataFrame([("Ann", 41)], "name string, age long"))
    again = GraphService(GraphStore(spark, str(tmp_path)))
    found = again.cypher_query("MATCH (a:Person)-[k:KNOWS]->(b:Person) RETURN a.age AS age, a.note AS note, b.name AS b")
    assert found.rows == [[41, "likes tea", "Bob"]] and not found.truncated
    assert again.cypher_query("MATCH (p:Person) RETURN p.name AS n", limit=1).truncated
    context = again.search_knowledge("tea")
    assert context.seeds[0]["node_id"] == "Person:Ann" and "Person:Ann -[KNOWS]-> Person:Bob" in context.text
    assert again.get_context(["Bob"]).text.startswith("Person:Bob {name: ")
    with pytest.raises(ReadOnlyViolation):
        again.cypher_query("MATCH (n) DELETE n")
    with pytest.raises(SchemaError):
        again.define_schema([NodeTable("_bad name", "id")])


def test_ingest_replaces(spark, tmp_path):
    service = GraphService(GraphStore(spark, str(tmp_path)))
    docs = lambda text: spark.createDataFrame([(text, "a/notes.md", None, 0), ("other", "b.md", None, 1)], "text string, source string, metadata string, ordinal int")
    service.ingest(docs("One sentence. " * 30), size=100, overlap=10)
    many = service.store.graph().nodes["Chunk"].count()
    service.ingest(docs("One sentence."), size=100, overlap=10)
    assert many > 3 and service.store.graph().nodes["Chunk"].count() == 2
