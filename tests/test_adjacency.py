"""Stored neighbour lists: the same expansion as by scans, fewer folders read, changes laid over them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.catalog import NodeTable, RelTable
from sparkloom.operators import adjacency, retrieve
from sparkloom.service import GraphService
from sparkloom.store import GraphStore


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edge_rows(seed=5):
    rnd = random.Random(seed)
    rest = [("K", f"A:{rnd.randrange(60)}", f"A:{rnd.randrange(60)}") for _ in range(80)]
    # a hub, a loop, a repeated edge, an edge without an end
    return rest + [("L", "A:0", f"B:{k}") for k in range(90)] + [("K", "A:7", "A:7"), rest[0], ("K", "A:1", None)]


def test_lists_equal_the_edges(spark, tmp_path):
    edges = edge_rows()
    given = spark.createDataFrame(edges, "type string, src string, dst string")
    state = adjacency.write_lists(given, str(tmp_path / "lists"), buckets=8, longest=16)
    lists = adjacency.Adjacency(spark, state)
    seeds = spark.createDataFrame([("A:1",), ("B:3",), ("A:none",)], "node_id string")
    whole = {e for e in edges if e[2]}
    assert state["edges"] == len([e for e in edges if e[2]])
    assert set(rows(lists.edges_at(seeds))) == {e for e in whole if {e[1], e[2]} & {"A:1", "B:3"}}
    hub = spark.read.parquet(state["folder"]).where("node = 'A:0'")
    assert hub.count() > 3 and hub.agg(F.max(F.size("near"))).first()[0] < 40
    for hops in (0, 1, 2):
        got, want = retrieve.expand(None, seeds, hops, lists=lists, edges=given), retrieve.expand(None, seeds, hops, edges=given.where("dst IS NOT NULL"))
        assert rows(got[0]) == rows(want[0]) and (hops == 0 or rows(got[1]) == rows(want[1]))
    assert not rows(lists.edges_at(seeds.limit(0)))
    # one node's level reads one folder of eight
    read = lists.lists(seeds.where("node_id = 'A:1'"))
    assert len({f.rsplit("/", 2)[1] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) <= 1
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", read._jdf.queryExecution().toString())


def test_no_edges(spark, tmp_path):
    state = adjacency.write_lists(spark.createDataFrame([], "type string, src string, dst string"), str(tmp_path / "none"))
    assert not rows(adjacency.Adjacency(spark, state).edges_at(spark.createDataFrame([("A:1",)], "node_id string")))


@pytest.fixture
def service(spark, tmp_path):
    out = GraphService(GraphStore(spark, str(tmp_path)))
    out.define_schema([NodeTable("A", "id", {}), NodeTable("B", "id", {})], [RelTable("K", "A", "A", {}), RelTable("L", "A", "B", {})])
    for label in "AB":
        out.upsert_nodes(label, spark.range(40).select(F.col("id").cast("string").alias("id")))
    out.upsert_edges("K", spark.range(30).select(F.col("id").cast("string").alias("_src"), (F.col("id") + 1).cast("string").alias("_dst")))
    out.upsert_edges("L", spark.range(30).select(F.lit("3").alias("_src"), F.col("id").cast("string").alias("_dst")))
    return out


def test_changes_are_laid_over(spark, service):
    assert service._lists() is None and service.index_relationships() == 60
    folder = service._lists().state["folder"]
    seeds = spark.createDataFrame([("A:4",), ("B:2",)], "node_id string")

    def same():
        graph = service.store.graph()
        got, want = retrieve.expand(graph, seeds, 2, lists=service._lists()), retrieve.expand(graph, seeds, 2)
        return rows(got[0]) == rows(want[0]) and rows(got[1].select("type", "src", "dst")) == rows(want[1].select("type", "src", "dst"))

    assert same()
    service.upsert_edges("K", spark.createDataFrame([("4", "20"), ("3", "4")], "_src string, _dst string"))
    service.delete_edges("L", [("3", "2")])
    assert same() and service._lists().state["folder"] == folder
    text = service.get_context(["A:4"], 1).text
    assert "A:20" in text
    # folded deltas cannot be laid over the lists
    service.store.compact("K")
    assert service._lists() is None and same()
    assert service.index_relationships() == 60 and service._lists().state["folder"] != folder and same()


@pytest.mark.parametrize("most", [200_000, 0])
def test_ends_are_not_shuffled_to_meet_hubs(spark, tmp_path, monkeypatch, most):
    """Few hubs are broadcast to the ends, however large Spark takes the ends to be; many are joined, with the same lists."""
    from pyspark.sql import DataFrameWriter

    plans, known = [], DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *names: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), known(self, *names))[1])
    if not most:
        monkeypatch.setattr(adjacency, "BROADCAST_HUBS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = adjacency.write_lists(spark.createDataFrame(edge_rows(), "type string, src string, dst string"), str(tmp_path / "lists"), buckets=4, longest=16)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("SortMergeJoin" in plans[0]) == (not most)
    found = spark.read.parquet(state["folder"]).select("node", F.explode("near").alias("e")).select("node", "e.type", "e.out", "e.other").collect()
    whole = {e for e in edge_rows() if e[2]}
    assert sorted(map(tuple, found)) == sorted([(s, t, True, d) for t, s, d in whole] + [(d, t, False, s) for t, s, d in whole])
