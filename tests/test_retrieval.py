import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.catalog import Graph, NodeTable, RelTable
from sparkloom.errors import ConfigurationError, SchemaError
from sparkloom.functions import codecs, vectors
from sparkloom.functions import text as bm
from sparkloom.operators import codecbench, embed, mentions, retrieve, textindex
from sparkloom.service import GraphService
from sparkloom.store import GraphStore


@pytest.fixture(scope="module")
def units():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 32))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codes(units, codec):
    blobs = codecs.encode(units, codec)
    want = codecs.blob_bytes(codec, 32)
    assert all(len(b) == (want or len(blobs[0])) for b in blobs)
    back = codecs.decode(blobs, codec, 32)
    cosine = (codecs.split_magnitude(back)[1] * units).sum(axis=1)
    assert cosine.mean() > {"fp32": 0.999999, "int8": 0.999, "binary": 0.75, "polar": 0.7}[codec]
    got = codecs.scores(blobs, units[0], codec)
    if codec == "binary":
        assert np.allclose(got, np.cos(np.pi * ((units >= 0) != (units[0] >= 0)).sum(axis=1) / 32))
    else:
        assert np.allclose(got, back @ units[0])
    assert np.allclose(codecs.cosines_from_codes(blobs[:5], blobs[:5], codec, 32), 1.0)
    with pytest.raises(ConfigurationError):
        codecs.decode([b"x"], codec, 32)


def test_zero_vectors_have_codes(units):
    some = np.vstack([units[:2], np.zeros((1, 32))])
    for codec in codecs.CODECS:
        blobs = codecs.encode(some, codec)
        assert len(blobs) == 3 and (codec in ("binary",) or codecs.scores(blobs, units[0], codec)[2] == 0)


@pytest.mark.parametrize("codec", ["int8", "binary", "polar"])
def test_stored_codes_give_what_codes_on_the_way_give(spark, folder, codec):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    query = [float(x) for x in table.where("vec_id = 7").first()["embedding"]]
    coded = codecs.with_codes(table, "embedding", codec)
    a, b = ([(r["key"], round(r["score"], 9)) for r in vectors.top_k(coded, "vec_id", "embedding", query, 10, codec, code).collect()] for code in (None, "_emb_code"))
    assert a == b and a[0][0] == 7
    assert vectors.top_k(coded, "vec_id", "embedding", [0.0] * 64, 5, codec).count() == 0
    with pytest.raises(ConfigurationError):
        vectors.top_k(table, "vec_id", "embedding", query, 5, "none")


def test_batch_search_is_exact(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}
    asked = [(q, rows[q].tolist()) for q in (0, 50, 100)]
    unit = lambda v: v / np.linalg.norm(v)
    for q, v in asked:
        best = sorted(rows, key=lambda k: (-float(unit(rows[k]) @ unit(np.array(v))), k))[:5]
        assert [r["key"] for r in codecs.batch_top_k(table, "vec_id", "embedding", asked, 5).where(F.col("query") == q).orderBy("rank").collect()] == best


def test_batch_search_takes_any_number_of_queries_and_orders_ties_by_key(spark):
    rng = np.random.default_rng(9)
    some = rng.normal(size=(400, 8)).astype(np.float32)
    values = np.vstack([some[i % 400] for i in range(2400)]).astype(np.float64)  # each vector six times, at different places of its block
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "id long, v array<double>").repartition(5)
    asked = table.where("id % 2 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))  # more than a block of queries
    found = {}
    for r in codecs.batch_top_k(table, "id", "v", asked, 4).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["key"], r["score"]))
    assert sorted(found) == list(range(0, 2400, 2))
    for q, hits in found.items():
        assert [k for k, _ in hits] == [q % 400 + 400 * i for i in range(4)] and len({s for _, s in hits}) == 1


def test_hash_embedder():
    one = embed.HashEmbedder(32)
    a, b, c = one.embed(["red fox", "Fox red", "something else"])
    assert a == b != c and sum(map(abs, a)) <= 6 and embed.make_embedder("hash", dim=32) is embed.make_embedder("hash", dim=32)
    assert embed.make_embedder(None) is None
    for wrong in ({"provider": "none"}, {"provider": "remote"}):
        with pytest.raises(ConfigurationError):
            embed.make_embedder(**wrong)


def test_remote_embedder():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            body = json.dumps({"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(asked)))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert embed.RemoteEmbedder(f"http://127.0.0.1:{server.server_port}/v1/", "m", 2).embed(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]]
    finally:
        server.shutdown()


def test_embedding_of_pending_rows(spark):
    df = spark.createDataFrame([("a", "red fox", None), ("b", None, None), ("c", "", "x")], "id string, title string, body string")
    done = embed.embed_pending(df, "id", embed.HashEmbedder(16), "int8", most=2)
    assert embed.pending_count(done) == 1 and embed.pending_count(df) == 0
    rows = {r["id"]: r for r in embed.embed_pending(done, "id", embed.HashEmbedder(16), "int8").collect()}
    assert [round(x, 5) for x in rows["a"]["embedding"]] == embed.HashEmbedder(16).embed(["a\nred fox"])[0] and len(rows["a"]["_emb_code"]) == 20
    assert [round(x, 5) for x in rows["b"]["embedding"]] == embed.HashEmbedder(16).embed(["b"])[0]
    with pytest.raises(ConfigurationError):
        embed.provision(done, 8)
    assert {r["_emb_model"] for r in embed.reindex(done, "id", embed.HashEmbedder(8)).collect()} == {"hash-8"}


def test_stored_index_scores_as_the_scan(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    terms = ["the", "thand", "nosuchword"]
    index = textindex.index_for(docs, "doc_id", ["text"], str(tmp_path))
    want = {r["key"]: round(r["score"], 9) for r in bm.bm25(docs, "doc_id", ["text"], terms).collect()}
    assert {r["key"]: round(r["score"], 9) for r in index.search(terms).collect()} == want
    assert textindex.index_for(docs, "doc_id", ["text"], str(tmp_path)) is index and textindex.index_for(docs, "doc_id", ["text", "lang"], str(tmp_path)) is not index
    assert "bucket" in index.search(terms)._jdf.queryExecution().executedPlan().toString() and index.search([]).count() == 0
    assert textindex.index_for(spark.range(3).selectExpr("id", "'x' AS t"), "id", ["t"], str(tmp_path)) is None


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "The Red Fox ran."), (2, "redfoxes"), (3, None), (4, "C++ and a red  fox; RED FOX")], "id long, text string")
    names = spark.createDataFrame([("red fox",), ("fox",), (None,), ("c++",), ("absent",)], "name string")
    got = lambda df: sorted((r["key"], r["name"]) for r in df.collect())
    assert got(mentions.contained(texts, "id", "text", names, "name")) == [(1, "fox"), (1, "red fox"), (2, "fox"), (4, "c++"), (4, "fox"), (4, "red fox")]
    assert got(mentions.mentioned(texts, "id", "text", names, "name")) == [(1, "fox"), (1, "red fox"), (4, "c++"), (4, "fox"), (4, "red fox")]
    assert got(mentions.pattern_mentions(texts, "id", "text", {"animal": ["fox", "hen"], "language": ["C++"]})) == [(1, "animal"), (4, "animal"), (4, "language")]


def test_codec_bench(spark):
    rows = {r["codec"]: r for r in codecbench.run(spark, n_docs=400, n_queries=10).collect()}
    assert rows["fp32"]["recall"] == 1.0 and rows["int8"]["recall"] > 0.9 and [rows[c]["code_bytes"] for c in codecs.CODECS] == [256, 68, 8, 14]


class Broken:
    dim, model_id = 16, "broken"

    def embed(self, texts):
        raise OSError("no network")


def test_search_with_vectors(spark, tmp_path):
    service = GraphService(GraphStore(spark, str(tmp_path)), embed.HashEmbedder(16), "int8")
    service.define_schema([NodeTable("Note", "id", {"text": "STRING"}, True), NodeTable("Tag", "name", {})], [RelTable("HAS", "Note", "Tag", {})])
    service.upsert_nodes("Note", spark.createDataFrame([("a", "red fox jumps"), ("b", "blue whale swims"), ("c", "green fox sleeps")], "id string, text string"))
    service.upsert_nodes("Tag", spark.createDataFrame([("animal",)], "name string"))
    service.upsert_edges("HAS", spark.createDataFrame([("a", "animal")], "_src string, _dst string"))
    found = service.search_knowledge("red fox")
    assert found.seeds[0]["node_id"] == "Note:a" and found.vector_status == "on" and found.pending_embeddings == 0 and "Tag:animal" in found.text
    assert '"seed_rank": 1' in found.with_footer().split("\n\n---\n")[1]
    service.upsert_nodes("Note", spark.createDataFrame([("b", "blue fox")], "id string, text string"))
    assert service.pending_embeddings("Note") == 1 and service.embed_pending("Note") == 1 and service.reindex("Note") == 3
    assert GraphService(service.store, Broken()).store is service.store
    broken = retrieve.search(service.store.graph(), "red fox", embedder=Broken())
    assert broken.vector_status == "error" and broken.seeds.count() > 0
    rows = service.cypher_query("CALL QUERY_FTS_INDEX('Note', 'i', 'whale fox', TOP := 2) RETURN node.id AS id, score").rows
    assert len(rows) == 2 and all(r[1] > 0 for r in rows)
    near = service.cypher_query("CALL QUERY_VECTOR_INDEX('Note', 'i', $v, 1) YIELD node, distance RETURN node.id AS id, distance", {"v": embed.HashEmbedder(16).embed(["green fox sleeps"])[0]})
    assert near.rows[0][0] in "abc"
    assert [r[0] for r in service.cypher_query("CALL SHOW_TABLES() RETURN *").rows] == ["Note", "Tag", "HAS"]
    sub = service.cypher_query("MATCH p = (n:Note)-[h:HAS]->(t:Tag) RETURN n, h, t, p").subgraph
    assert list(sub.nodes) == ["Note:a", "Tag:animal"] and list(sub.edges) == ["HAS:Note:a->Tag:animal"]
    assert list(sub.matching("fox").nodes) == ["Note:a"] and sub.merge(sub) == sub
    sample = service.sample_graph(10)
    assert len(sample["nodes"]) == 4 and len(sample["edges"]) == 1


def test_unknown_labels_and_keys(spark):
    graph = Graph().add_nodes("A", spark.createDataFrame([(1,), (2,)], "id long"), "id").add_nodes("B", spark.createDataFrame([("2",)], "id string"), "id")
    assert [r[0] for r in retrieve.resolve_keys(graph, ["A:2", "1"]).collect()] == ["A:2", "A:1"]
    for wrong in ("2", "nothing"):
        with pytest.raises(SchemaError):
            retrieve.resolve_keys(graph, [wrong])


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_scores_from_codes_equal_decoding(codec):
    rnd = np.random.default_rng(3)
    units = codecs.split_magnitude(rnd.normal(size=(50, 24)))[1]
    units[7] = 0
    blobs = codecs.encode(units, codec, 3.0)
    column = pa.array([b"left out", *blobs], pa.binary())[1:]
    score = codecs.scorer(column, codec, 24)
    for query in units[:5]:
        got = score(query)
        assert np.allclose(got, codecs.scores(blobs, query, codec), atol=1e-12)
        if codec != "binary":
            assert np.allclose(got, codecs.decode(blobs, codec, 24) @ query, atol=1e-9)
    assert len(codecs.scorer(column[:0], codec, 24)(units[0])) == 0
