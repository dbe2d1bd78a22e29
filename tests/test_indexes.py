"""Deltas, segments of the text index and cells of the vector index: same rows as a scan, and less read and written."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.catalog import NodeTable, RelTable
from sparkloom.errors import SchemaError
from sparkloom.functions import text as bm
from sparkloom.functions import codecs, vectors
from sparkloom.operators import embed, textindex, vectorindex
from sparkloom.service import GraphService
from sparkloom.store import DELETED, GraphStore

rng = random.Random(8)
WORDS = [f"word{k}" for k in range(300)]


def text(k):
    return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(300)], k=20 + k % 30))


def some_docs(spark, ids):
    return spark.createDataFrame([(f"d{k}", text(k)) for k in ids], "id string, body string")


@pytest.fixture
def service(spark, tmp_path):
    out = GraphService(GraphStore(spark, str(tmp_path)))
    out.define_schema([NodeTable("Doc", "id", {"body": "STRING"}, True)], [RelTable("LIKE", "Doc", "Doc", {"w": "DOUBLE"})])
    return out


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def scores(df):
    return [(r["key"], round(r["score"], 9)) for r in df.orderBy(F.desc("score"), "key").limit(15).collect()]


def scan(service, terms):
    return scores(bm.bm25(service.store.table("Doc"), "id", ["id", "body"], terms))


# deltas


def test_a_write_is_as_large_as_its_change(spark, service, tmp_path):
    service.upsert_nodes("Doc", some_docs(spark, range(2000)))
    service.compact("Doc")
    before = folder_bytes(tmp_path / "tables")
    old = service.store.version()
    service.upsert_nodes("Doc", spark.createDataFrame([("d5", "new text"), ("e1", "added")], "id string, body string"))
    assert service.set_properties("Doc", ["d6", "none"], {"body": "set"}) == 1
    assert service.delete_nodes("Doc", ["d7", "none"]) == 1
    assert folder_bytes(tmp_path / "tables") - before < before / 4
    have = {r["id"]: r["body"] for r in service.store.table("Doc").collect()}
    assert len(have) == 2000 and have["d5"] == "new text" and have["d6"] == "set" and "d7" not in have and have["e1"] == "added"
    # a reader of the earlier version sees the earlier rows
    assert service.store.at(old).table("Doc").where("id IN ('d7', 'e1')").count() == 1
    assert service.compact("Doc") == 3 and not service.store.entry("Doc")["deltas"]
    assert {r["id"]: r["body"] for r in service.store.table("Doc").collect()} == have


def test_only_pages_of_the_keys_are_asked_for(spark, service):
    service.upsert_nodes("Doc", some_docs(spark, range(50)))
    service.compact("Doc")
    plan = service.store.rows_of("Doc", spark.createDataFrame([("d5",)], "id string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_bucket), EqualTo(_bucket," in plan or "In(_bucket" in plan


def test_writers_of_other_rows_do_not_collide(spark, service):
    service.upsert_nodes("Doc", some_docs(spark, range(10)))
    other = GraphService(GraphStore(spark, service.store.path))
    service.upsert_nodes("Doc", spark.createDataFrame([("d1", "one")], "id string, body string"))
    other.upsert_nodes("Doc", spark.createDataFrame([("d2", "two")], "id string, body string"))  # has not seen the write before
    with pytest.raises(SchemaError):
        service.upsert_nodes("Doc", spark.createDataFrame([("d2", "three")], "id string, body string"))
    service.store.refresh()
    have = {r["id"]: r["body"] for r in service.store.table("Doc").where("id IN ('d1', 'd2')").collect()}
    assert have == {"d1": "one", "d2": "two"}
    # compaction hinders no writer, a replaced table does
    other.compact("Doc")
    service.upsert_nodes("Doc", spark.createDataFrame([("d3", "x")], "id string, body string"))
    other.store.refresh()
    other.store.replace({"Doc": other.store.table("Doc")})
    with pytest.raises(SchemaError):
        service.upsert_nodes("Doc", spark.createDataFrame([("d4", "y")], "id string, body string"))


def test_deleted_nodes_take_their_edges(spark, service, tmp_path):
    service.upsert_nodes("Doc", some_docs(spark, range(30)))
    service.upsert_edges("LIKE", spark.createDataFrame([(f"d{k}", f"d{(k * 7) % 30}", 1.0) for k in range(30)], "_src string, _dst string, w double"))
    service.delete_nodes("Doc", ["d1", "d2"])
    left = {(r["_src"], r["_dst"]) for r in service.store.table("LIKE").collect()}
    assert left == {(f"d{k}", f"d{(k * 7) % 30}") for k in range(30) if not {k, (k * 7) % 30} & {1, 2}}
    service.upsert_edges("LIKE", spark.createDataFrame([("d3", "d4", 2.0)], "_src string, _dst string, w double"))
    assert service.store.table("LIKE").count() == len(left) + 1


def test_vacuum_keeps_what_kept_versions_name(spark, service, tmp_path):
    for k in range(5):
        service.upsert_nodes("Doc", spark.createDataFrame([("a", f"text {k}")], "id string, body string"))
    reader = service.store.at(service.store.version())
    service.store.replace({"Doc": service.store.table("Doc")})
    assert service.vacuum(keep=1, older_than_s=3600) == 0  # all is young
    time.sleep(0.1)
    assert service.vacuum(keep=2, older_than_s=0) == 0  # the version before names the base and all deltas
    assert [r["body"] for r in reader.table("Doc").collect()] == ["text 4"]
    assert service.vacuum(keep=1, older_than_s=0) == 6
    assert [r["body"] for r in GraphStore(spark, service.store.path).table("Doc").collect()] == ["text 4"]
    with pytest.raises(SchemaError):
        service.store.at(1)


# text


def test_text_segments_equal_the_scan(spark, service, tmp_path):
    service.upsert_nodes("Doc", some_docs(spark, range(1500)))
    index = lambda: service._text_index("Doc")
    for terms in (["word0", "word200"], ["word3", "word299", "nothing"], ["nothing"]):
        assert scores(index().search(terms, k=15)) == scan(service, terms) == scores(index().search(terms))
    whole = folder_bytes(tmp_path / "indexes")
    service.upsert_nodes("Doc", some_docs(spark, [*range(0, 1500, 100), 5000]))
    service.delete_nodes("Doc", ["d3", "d4"])
    for terms in (["word0", "word200"], ["word1"], ["word250", "word7", "word30"]):
        assert scores(index().search(terms, k=15)) == scan(service, terms)
    assert len(index().segments) == 2 and folder_bytes(tmp_path / "indexes") - whole < whole / 5
    service.upsert_nodes("Doc", spark.createDataFrame([("d0", "word0 word0")], "id string, body string"))
    service.compact("Doc")  # the index sees the change before it is folded
    assert len(index().segments) == 3 and scores(index().search(["word0"], k=15)) == scan(service, ["word0"])
    service.store.replace({"Doc": service.store.table("Doc").where("id <> 'd0'")})
    assert len(index().segments) == 1 and scores(index().search(["word0"], k=15)) == scan(service, ["word0"])


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 8)
    docs = [(k, " ".join(["one"] * ((k % 2 == 0) + (k % 97 == 0) * 20) + ["two"] * ((k % 3 == 0) + (k % 97 == 0) * 20) + ["filler"] * 40)) for k in range(4000)]
    df = spark.createDataFrame(docs, "id long, body string")
    made = textindex.write_segment(df, None, "id", ["body"], f"{tmp_path}/seg")
    index, read = textindex.TextIndex(spark, [made]), []
    whole = index._postings
    monkeypatch.setattr(index, "_postings", lambda parts, *rest: (read.append(sum(p.count() for p in parts)), whole(parts, *rest))[1])
    terms = ["one", "two"]
    got = scores(index.search(terms, k=15))
    stored = sum(p.count() for p in index.blocks(terms))
    assert got == scores(bm.bm25(df, "id", ["body"], terms)) and sum(read) < stored / 4
    one = index.search(["two"], k=5)
    assert scores(one)[:5] == scores(bm.bm25(df, "id", ["body"], ["two"]))[:5]
    assert "GreaterThanOrEqual(level," in one._jdf.queryExecution().executedPlan().toString()


# vectors


@pytest.fixture(scope="module")
def clustered(spark):
    g = np.random.default_rng(3)
    centers = g.normal(size=(40, 24))
    rows = [(k, [float(x) for x in (centers[k % 40] + 0.15 * g.normal(size=24)) * g.uniform(0.5, 2)]) for k in range(2000)]
    rows += [(3000, [0.0] * 24), (3001, None), *[(4000 + k, rows[0][1]) for k in range(30)]]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(4)


def nearest(df, query, k=10):
    return [(r["key"], round(r["score"], 9)) for r in vectors.top_k(df, "id", "v", query, k).collect()]


def test_cells_are_exact_and_few(spark, clustered, tmp_path):
    made = vectorindex.write_segment(clustered, None, "id", "v", f"{tmp_path}/v")
    index = vectorindex.VectorIndex(spark, [made])
    assert sum(index.sizes.values()) == 2031 and index.sizes[vectorindex.NOWHERE] == 1
    for k in (0, 1, 17, 1999):
        query = [float(x) for x in clustered.where(F.col("id") == k).first()["v"]]
        found = index.search(query, 10)
        assert [(r["key"], round(r["score"], 9)) for r in found.collect()] == nearest(clustered, query)
        cells = index.exact_cells(query, 10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(cells) < len(index.cells) / 2 and "PartitionFilters: [cell" in plan
    # far from everything, and more rows than there are: all cells are read
    query = [-1.0] * 24
    assert [(r["key"], round(r["score"], 9)) for r in index.search(query, 3000).collect()] == nearest(clustered, query, 3000)
    assert index.search([0.0] * 24, 5).count() == 0


def test_recall_of_nearest_cells(spark, clustered, tmp_path):
    index = vectorindex.VectorIndex(spark, [vectorindex.write_segment(clustered, None, "id", "v", f"{tmp_path}/v")])
    asked = clustered.where("id % 50 = 0 AND id < 2000")
    found = index.search_many(asked.select(F.col("id").alias("query"), F.col("v").alias("vector")), 10).collect()
    hits = 0
    for r in asked.collect():
        true = {k for k, _ in nearest(clustered, [float(x) for x in r["v"]])}
        hits += len(true & {x["key"] for x in found if x["query"] == r["id"]})
    assert hits >= 0.9 * 10 * asked.count() and index.probes() < len(index.cells) / 2


def test_queries_do_not_make_a_row_for_each_cell_and_vector(spark, clustered, tmp_path):
    index = vectorindex.VectorIndex(spark, [vectorindex.write_segment(clustered, None, "id", "v", f"{tmp_path}/v")])
    found = index.search_many(clustered.where("id % 40 = 0 AND id < 2000").select(F.col("id").alias("query"), F.col("v").alias("vector")), 5, probes=len(index.cells))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan
    # with all cells read it is the exact search
    whole = codecs.batch_top_k(clustered, "id", "v", clustered.where("id % 40 = 0 AND id < 2000").select(F.col("id").alias("query"), F.col("v").alias("vector")), 5)
    assert sorted(map(tuple, found.select("query", "key", "rank").collect())) == sorted(map(tuple, whole.select("query", "key", "rank").collect()))


def test_vectors_follow_their_table(spark, tmp_path):
    service = GraphService(GraphStore(spark, str(tmp_path)), embed.HashEmbedder(16))
    service.define_schema([NodeTable("Doc", "id", {"body": "STRING"}, True)])
    service.upsert_nodes("Doc", some_docs(spark, range(300)))
    assert service.embed_pending("Doc") == 300 and service.pending_embeddings("Doc") == 0
    query = [float(x) for x in service.store.table("Doc").where("id = 'd9'").first()["embedding"]]
    check = lambda: [(r["key"], round(r["score"], 9)) for r in service._nearest("Doc", query, 8).collect()] == [(r["key"], round(r["score"], 9)) for r in vectors.top_k(service.store.table("Doc"), "id", "embedding", query, 8).collect()]
    assert check()
    service.upsert_nodes("Doc", spark.createDataFrame([("d9", "changed words here"), ("x", "word1 word2")], "id string, body string"))
    assert service.pending_embeddings("Doc") == 2 and check()
    size = folder_bytes(tmp_path / "tables")
    context = service.search_knowledge("changed words")  # makes the two vectors, as a delta
    assert context.pending_embeddings == 0 and context.vector_status == "on" and context.seeds[0]["node_id"] == "Doc:d9"
    assert folder_bytes(tmp_path / "tables") - size < size / 4 and check()
    assert len(vectorindex.index_of(service.store, "Doc").segments) > 1
    service.delete_nodes("Doc", ["d9"])
    assert check()
    service.reindex("Doc")
    assert check() and len(vectorindex.index_of(service.store, "Doc").segments) == 1


# mentions


def test_many_names_without_a_nested_loop(spark, monkeypatch):
    from sparkloom.errors import ConfigurationError
    from sparkloom.operators import mentions

    names = spark.range(100_000).select(F.concat(F.lit("Name"), F.col("id").cast("string"), F.lit("x")).alias("name"))
    texts = spark.createDataFrame([(1, "a NAME7x and name99999x"), (2, "prename12xy"), (3, None), (4, "")], "id long, body string")
    found = mentions.contained(texts, "id", "body", names, "name")
    got = lambda df: sorted((r["key"], r["name"]) for r in df.collect())
    assert got(found) == [(1, "Name7x"), (1, "Name99999x"), (2, "Name12x")]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    aliases = names.select(F.lower("name").alias("alias"), F.upper("name").alias("name"))
    assert got(mentions.pattern_mentions(texts, "id", "body", aliases)) == [(1, "NAME7X"), (1, "NAME99999X")]
    # several automata give the same, too many are an error
    monkeypatch.setattr(mentions, "AUTOMATON_CHARS", 400_000)
    assert got(mentions.contained(texts, "id", "body", names, "name")) == got(found)
    monkeypatch.setattr(mentions, "MOST_AUTOMATA", 2)
    with pytest.raises(ConfigurationError):
        mentions.contained(texts, "id", "body", names, "name")


def test_terms_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "a b a", "b"), (2, None, "Ü ü"), (3, "", None), (4, "a", "a")], "id long, text string, more string")
    got = bm.counted(df, "id", ["text", "more"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm.postings(df, "id", ["text", "more"]).select("key", "term", "tf", "dl").collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_hybrid_search_indexes_texts_without_a_join(spark, folder, monkeypatch):
    from sparkloom import queries

    plans, index_for = [], textindex.index_for
    monkeypatch.setattr(textindex, "index_for", lambda df, *rest: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or index_for(df, *rest))
    monkeypatch.setattr(queries.textindex, "shared_root", lambda spark: queries.scratch_folder(spark))
    assert queries.hybrid_seeds(spark, folder).count() == 8 and plans and not any("Join" in p for p in plans)


def test_reading_a_changed_table_needs_no_index(spark, folder, monkeypatch):
    from sparkloom import queries

    monkeypatch.setattr(GraphService, "_text_index", lambda *_: 1 / 0)
    assert queries.delta_rows(spark, folder).count() > 0


@pytest.mark.parametrize("kind", [pa.int64(), pa.int32(), pa.string(), None])
def test_postings_travel_as_runs(kind):
    """What is shuffled for the text index is a row for up to RUN postings of a word, not one for each, and blocks hold just these postings."""
    rng = np.random.default_rng(3)
    n, mean = 6000, 50.0
    number = rng.integers(-(2**31), 2**31 - 1, n) if kind != pa.int64() else np.concatenate(([-(2**63), 2**63 - 1], rng.integers(-(2**62), 2**62, n - 2)))
    key = pa.array([None if i % 7 == 0 else int(x) for i, x in enumerate(number)], pa.int64()) if kind is None else pa.array([str(x) for x in number]) if kind == pa.string() else pa.array(number, kind)
    term = pa.array([f"w{x}" for x in rng.zipf(1.5, n) % 300])
    postings = pa.table([key, term, pa.array(rng.integers(1, 9, n)), pa.array(rng.integers(1, 3000, n).astype(np.int32))], ["key", "term", "tf", "dl"])
    runs = pa.Table.from_batches(list(textindex._as_runs(postings, mean)))
    assert runs.num_rows == sum(-(-c // textindex.RUN) for c in Counter(term.to_pylist()).values()) < n / 15
    runs = runs.append_column("bucket", pa.array(np.zeros(runs.num_rows, np.int32)))
    runs = runs.take(pa.array(np.lexsort((-runs["level"].to_numpy(), np.array(runs["term"].to_pylist()))))).combine_chunks()
    got = []
    for batch in textindex._blocks(mean)(iter(runs.to_batches(max_chunksize=37))):
        for row in batch.to_pylist():
            assert row["level"] == textindex._levels(np.array(row["tfs"]), np.array(row["lengths"]), mean).max() and row["n"] == len(row["keys"]) <= textindex.BLOCK
            got += [(row["term"], *x) for x in zip(row["keys"], row["tfs"], row["lengths"], strict=True)]
    assert Counter(got) == Counter(zip(*(postings[c].to_pylist() for c in ("term", "key", "tf", "dl")), strict=True))
    assert list(textindex._runs(mean)(iter([]))) == list(textindex._blocks(mean)(iter([]))) == []
