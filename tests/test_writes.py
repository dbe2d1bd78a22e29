import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.catalog import NodeTable, RelTable
from sparkloom.errors import NotFoundError, SchemaError
from sparkloom.operators import mutate, subgraph
from sparkloom.registry import GraphRegistry
from sparkloom.service import GraphService
from sparkloom.store import GraphStore


@pytest.fixture
def service(spark, tmp_path):
    out = GraphService(GraphStore(spark, str(tmp_path)))
    out.define_schema([NodeTable("Doc", "id", {"title": "STRING", "year": "INT64", "score": "DOUBLE", "good": "BOOL", "day": "DATE"}, True), NodeTable("Tag", "name", {})], [RelTable("HAS", "Doc", "Tag", {"w": "DOUBLE"})])
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_values_are_coerced_or_left_out(spark, service):
    batch = spark.createDataFrame([("a", "T", " 7 ", 3, True, 1, 1), ("b", "U", "seven", 4, False, 2, 2)], "id string, title string, year string, score int, good boolean, extra int, _emb_r int")
    report = service.upsert_nodes("Doc", batch)
    assert rows(service.store.table("Doc"), "id", "title", "year", "score", "good") == [("a", "T", 7, 3.0, True), ("b", "U", None, 4.0, False)]
    assert report.written == 2 and len(report.warnings) == 3 and any("1 values" in w for w in report.warnings)
    report = service.upsert_nodes("Doc", spark.createDataFrame([("a", True, 5)], "id string, year boolean, title int"))
    assert rows(service.store.table("Doc").where("id = 'a'"), "title", "year") == [("T", 7)] and len(report.warnings) == 2


def test_a_supplied_null_clears_a_date(spark, service):
    day = datetime.date(2024, 1, 2)
    service.upsert_nodes("Doc", spark.createDataFrame([("a", day), ("b", day)], "id string, day date"))
    service.upsert_nodes("Doc", spark.createDataFrame([("a", None, True), ("b", None, False)], f"id string, day date, {mutate.SUPPLIED}day boolean"))
    assert rows(service.store.table("Doc"), "id", "day") == [("a", None), ("b", day)]


def test_create_set_delete(spark, service):
    service.create_nodes("Doc", spark.createDataFrame([("a", "x"), ("b", "y")], "id string, title string"))
    service.create_nodes("Tag", spark.createDataFrame([("t",), ("u",)], "name string"))
    service.create_edges("HAS", spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "t")], "_src string, _dst string"))
    with pytest.raises(SchemaError):
        service.create_nodes("Doc", spark.createDataFrame([("a", "z")], "id string, title string"))
    with pytest.raises(NotFoundError):
        service.upsert_edges("HAS", spark.createDataFrame([("a", "none")], "_src string, _dst string"))
    assert service.set_properties("Doc", ["a"], {"title": None, "year": 5}) == 1
    assert rows(service.store.table("Doc"), "id", "title", "year") == [("a", None, 5), ("b", "y", None)]
    with pytest.raises(SchemaError):
        service.set_properties("Doc", ["a"], {"nothing": 1})
    assert service.delete_edges("HAS", [("a", "u"), ("b", "u")]) == 1
    assert service.delete_nodes("Doc", ["a", "zz"]) == 1
    assert rows(service.store.table("HAS"), "_src", "_dst") == [("b", "t")]
    service.add_columns("Doc", {"more": "INT64"})
    assert "more" in service.store.table("Doc").columns


def test_two_writers(spark, service):
    other = GraphService(GraphStore(spark, service.store.path))
    service.upsert_nodes("Tag", spark.createDataFrame([("t",)], "name string"))
    other.upsert_nodes("Doc", spark.createDataFrame([("a", "x")], "id string, title string"))  # another table: both stay
    assert rows(GraphStore(spark, service.store.path).table("Tag"), "name") == [("t",)]
    with pytest.raises(SchemaError):
        service.upsert_nodes("Doc", spark.createDataFrame([("a", "y")], "id string, title string"))  # the row was changed meanwhile
    service.upsert_nodes("Doc", spark.createDataFrame([("b", "y")], "id string, title string"))  # another row: both stay
    assert rows(service.store.table("Doc"), "id", "title") == [("a", "x"), ("b", "y")]


def test_nothing_is_written_if_any_name_is_wrong(spark, service):
    for nodes, rels in (([NodeTable("New", "_id")], []), ([NodeTable("New", "id"), NodeTable("New", "id")], []), ([NodeTable("New", "id", {"embedding": "STRING"})], []), ([], [RelTable("R", "Doc", "None")]), ([], [RelTable("HAS", "Tag", "Doc")])):
        with pytest.raises(SchemaError):
            service.define_schema(nodes, rels)
    assert "New" not in service.store.graph().nodes
    service.define_schema([NodeTable("Doc", "id", {}, False)])
    assert not service.store.graph().node_specs["Doc"].searchable and "title" in service.store.table("Doc").columns


def test_import_is_idempotent(spark, service, tmp_path):
    service.upsert_nodes("Doc", spark.createDataFrame([("a", "x", 3)], "id string, title string, year long"))
    service.upsert_nodes("Tag", spark.createDataFrame([("t",)], "name string"))
    service.upsert_edges("HAS", spark.createDataFrame([("a", "t", 0.5)], "_src string, _dst string, w double"))
    service.export_to(f"{tmp_path}/out")
    lines = spark.read.text(f"{tmp_path}/out").union(spark.createDataFrame([('{"type": "strange"}',), ('{"type": "edge", "rel": "HAS", "from": "Doc:a", "to": "Tag:gone"}',)], "value string"))
    lines.coalesce(1).write.text(f"{tmp_path}/in")
    other = GraphService(GraphStore(spark, f"{tmp_path}/other"))
    for _ in range(2):
        report = other.import_from(f"{tmp_path}/in")
        assert report.written == 3 and len(report.warnings) == 2
        assert rows(other.store.table("Doc"), "id", "title", "year", "_created_at") == rows(service.store.table("Doc"), "id", "title", "year", "_created_at")
        assert rows(other.store.table("HAS"), "_src", "_dst", "w") == [("a", "t", 0.5)]
    other.upsert_nodes("Doc", spark.createDataFrame([("a", "later")], "id string, title string"))
    other.import_from(f"{tmp_path}/in")
    assert rows(other.store.table("Doc"), "id", "title") == [("a", "x")]


def test_ingest_prunes_by_document_and_source(spark, tmp_path):
    service = GraphService(GraphStore(spark, str(tmp_path)))
    docs = lambda n, source: spark.createDataFrame([("One sentence. " * n, source, None, 0)], "text string, source string, metadata string, ordinal int")
    first = service.ingest(docs(30, "a/notes.md"), size=100, overlap=10)
    assert first.written > 3 and first.removed == 0
    assert service.ingest(docs(1, "a/notes.md"), size=100, overlap=10).removed == first.written - 1
    service.ingest(docs(2, None))
    assert service.store.table("Chunk").count() == 2


def test_frames_of_subgraphs(spark):
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    two = spark.createDataFrame([("b", "z"), ("c", "w")], "id string, v string")
    assert rows(subgraph.merge_frames([one, two]), "id", "v") == [("a", "x"), ("b", "y"), ("c", "w")]
    assert rows(subgraph.first_per(two.union(two.withColumn("v", F.lit("a"))), ["id"], [F.col("v")]), "id", "v") == [("b", "a"), ("c", "a")]


def test_registry(spark, tmp_path):
    graphs = GraphRegistry(spark, str(tmp_path))
    for name in ("alpha", "beta"):
        graphs.service(name).define_schema([NodeTable("Item", "id", {"name": "STRING"})])
        graphs.service(name).upsert_nodes("Item", spark.createDataFrame([(name,)], "id string"))
    assert GraphRegistry(spark, str(tmp_path)).names() == ["alpha", "beta"] and graphs.service("alpha") is graphs.service("alpha")
    assert rows(graphs.service("beta").store.table("Item"), "id") == [("beta",)]
    with pytest.raises(NotFoundError):
        graphs.service("gamma", create=False)
    with pytest.raises(SchemaError):
        graphs.service("../x")
