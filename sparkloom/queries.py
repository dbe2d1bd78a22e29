"""The library's queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import NodeTable
from .functions import codecs, vectors
from .functions import text as bm
from .operators import adjacency, chunk, codegraph, embed, mentions, mutate, pack, retrieve, subgraph, textindex, vectorindex
from .plans.compiler import cypher
from .service import GraphService
from .session import scratch_folder
from .sources.testgraph import table_graph
from .sources.transfer import export_lines
from .store import DELETED, GraphStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _cypher(name: str, text: str, sql: str, columns: list[str] | None = None, **params) -> None:
    """A query in Cypher; ``columns`` renames expression-named columns for comparison."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = cypher(table_graph(spark, folder), text, params)
        return out.toDF(*columns) if columns else out

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


# scans, filters and projections

_cypher("node_scan_filter", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 AND c.c_mktsegment <> 'BUILDING' RETURN c.c_custkey AS k, c.c_name AS name, c.c_acctbal AS bal", "SELECT c_custkey k, c_name AS name, c_acctbal bal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
_cypher("node_in_list", "MATCH (n:Nation) WHERE n.n_nationkey IN $keys AND NOT n.n_regionkey IN [0] RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey k, n_name AS name FROM nation WHERE n_nationkey IN (1,3,5,7,24) AND n_regionkey NOT IN (0)", keys=[1, 3, 5, 7, 24])
_cypher("inline_properties", "MATCH (r:Region {r_regionkey: 1})<-[:IN_REGION]-(n:Nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
_cypher("string_starts_contains", "MATCH (p:Part) WHERE p.p_name STARTS WITH 'P' OR p.p_type CONTAINS 'BRASS' OR p.p_brand ENDS WITH '3' RETURN p.p_partkey AS k", "SELECT p_partkey k FROM part WHERE starts_with(p_name,'P') OR contains(p_type,'BRASS') OR ends_with(p_brand,'3')")
_cypher("node_null_checks", "MATCH (d:Doc) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l:Label) WITH d, l WHERE l IS NULL RETURN d.doc_id AS k", "SELECT doc_id k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_cypher("default_names", "MATCH (r:Region) RETURN r.r_name, r.r_regionkey", "SELECT r_name AS c0, r_regionkey AS c1 FROM region", columns=["c0", "c1"])
_cypher("regex_match", "MATCH (s:Supplier) WHERE s.s_name =~ '.*[05]' RETURN s.s_suppkey AS k", "SELECT s_suppkey k FROM supplier WHERE regexp_full_match(s_name, '.*[05]')")
_cypher("case_arithmetic", "MATCH (o:Order) RETURN o.o_orderkey AS k, CASE WHEN o.o_totalprice > 200000 THEN 'high' WHEN o.o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, o.o_orderkey / 7 AS whole, o.o_orderkey % 7 AS rest, toUpper(o.o_orderstatus) + '-' + toString(o.o_custkey) AS tag", "SELECT o_orderkey k, CASE WHEN o_totalprice>200000 THEN 'high' WHEN o_totalprice>50000 THEN 'mid' ELSE 'low' END band, o_orderkey // 7 AS whole, o_orderkey % 7 AS rest, upper(o_orderstatus)||'-'||o_custkey::VARCHAR AS tag FROM orders")
_cypher("string_functions", "MATCH (c:Customer) RETURN c.c_custkey AS k, substring(c.c_name, 2, 4) AS s, left(c.c_name, 3) AS l, reverse(c.c_name) AS r, size(c.c_name) AS n, replace(c.c_mktsegment, 'A', '_') AS x", "SELECT c_custkey k, substr(c_name,3,4) s, left(c_name,3) l, reverse(c_name) r, length(c_name) n, replace(c_mktsegment,'A','_') x FROM customer")
_cypher("list_functions", "MATCH (n:Nation) WITH n, [x IN range(0, n.n_nationkey) WHERE x % 3 = 0 | x * 2] AS xs RETURN n.n_nationkey AS k, size(xs) AS n_xs, reduce(t = 0, x IN xs | t + x) AS total, any(x IN xs WHERE x > 20) AS big, xs[0] AS first", "SELECT n_nationkey k, len(xs) n_xs, list_sum(xs)::INT AS total, len(list_filter(xs, lambda x: x>20))>0 big, xs[1]::INT AS first FROM (SELECT n_nationkey, list_transform(list_filter(range(0,n_nationkey+1), lambda x: x%3=0), lambda x: x*2) xs FROM nation)")

# aggregates, ordering, sets

_cypher("count_star", "MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) n FROM orders")
_cypher("group_agg", "MATCH (o:Order) RETURN o.o_orderpriority AS p, count(*) AS n, round(sum(o.o_totalprice), 2) AS total, round(avg(o.o_totalprice), 4) AS mean, min(o.o_orderdate) AS first, max(o.o_totalprice) AS top", "SELECT o_orderpriority p, count(*) n, round(sum(o_totalprice),2) total, round(avg(o_totalprice),4) mean, min(o_orderdate) AS first, max(o_totalprice) top FROM orders GROUP BY 1")
_cypher("count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, count(DISTINCT c) AS customers, count(DISTINCT o.o_orderpriority) AS priorities, count(o) AS orders", "SELECT c_mktsegment seg, count(DISTINCT c_custkey) customers, count(DISTINCT o_orderpriority) priorities, count(*) orders FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1")
_cypher("distinct_return", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) RETURN DISTINCT n.n_regionkey AS r", "SELECT DISTINCT n_regionkey r FROM supplier JOIN nation ON s_nationkey=n_nationkey")
_cypher("order_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS price ORDER BY o.o_totalprice DESC, k LIMIT 25", "SELECT o_orderkey k, o_totalprice price FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
_cypher("order_skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_acctbal, c.c_custkey SKIP 10 LIMIT 15", "SELECT c_custkey k FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 10")
_cypher("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey n FROM customer UNION SELECT s_nationkey FROM supplier")
_cypher("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_cypher("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.o_totalprice) AS spent WHERE n >= 3 RETURN c.c_mktsegment AS seg, count(*) AS customers, round(sum(spent), 2) AS spent", "SELECT c_mktsegment seg, count(*) customers, round(sum(spent),2) spent FROM (SELECT c_custkey, c_mktsegment, count(*) n, sum(o_totalprice) spent FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2) WHERE n>=3 GROUP BY 1")
_cypher("unwind_range", "UNWIND range(1, 5) AS x MATCH (r:Region) WHERE r.r_regionkey < x RETURN x, count(*) AS n", "SELECT x::INT AS x, count(*) n FROM range(1,6) t(x) JOIN region ON r_regionkey < x GROUP BY 1")
_cypher("collect_list_sorted", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.n_name) AS names RETURN r.r_name AS region, size(names) AS n, list_to_string('|', list_sort(names)) AS names", "SELECT r_name region, count(*) n, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1")

# joins along relationships

_cypher("one_hop_agg", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 RETURN c.c_mktsegment AS seg, count(*) AS n", "SELECT c_mktsegment seg, count(*) n FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_totalprice>1000 GROUP BY 1")
_cypher("two_hop_chain", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[h:HAS_PART]->(p:Part) WHERE h.quantity > 45 RETURN c.c_mktsegment AS seg, p.p_brand AS brand, count(*) AS n, round(sum(h.extendedprice * (1 - h.discount)), 2) AS revenue", "SELECT c_mktsegment seg, p_brand brand, count(*) n, round(sum(l_extendedprice*(1-l_discount)),2) revenue FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE l_quantity>45 GROUP BY 1,2")
_cypher("mixed_arrows_neq", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer), (s:Supplier)-[:BASED_IN]->(n) WHERE c.c_acctbal > s.s_acctbal RETURN r.r_name AS region, count(*) AS n", "SELECT r_name region, count(*) n FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey JOIN supplier ON s_nationkey=n_nationkey WHERE c_acctbal>s_acctbal GROUP BY 1")
_cypher("undirected_degree", "MATCH (n:Nation)-[r]-(x) RETURN n.n_nationkey AS k, count(*) AS degree", "SELECT k, count(*) degree FROM (SELECT n_nationkey k FROM nation UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
_cypher("rel_scan", "MATCH ()-[r:HAS_PART]->() RETURN count(*) AS n, round(sum(r.quantity), 2) AS q", "SELECT count(*) n, round(sum(l_quantity),2) q FROM lineitem")
_cypher("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_custkey AS k, count(o) AS n", "SELECT c_custkey k, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>100000 GROUP BY 1")
_cypher("cartesian_points", "MATCH (a:Region {r_regionkey: 0}), (b:Nation {n_nationkey: 3}) RETURN a.r_name AS a, b.n_name AS b", "SELECT r_name a, n_name b FROM region, nation WHERE r_regionkey=0 AND n_nationkey=3")
_cypher("semi_exists", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 } AND c.c_acctbal > 0 RETURN c.c_custkey AS k", "SELECT c_custkey k FROM customer WHERE c_acctbal>0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>250000)")
_cypher("anti_exists", "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 150000 } RETURN c.c_custkey AS k", "SELECT c_custkey k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
_cypher("count_subquery", "MATCH (n:Nation) WHERE COUNT { (n)<-[:LIVES_IN]-(:Customer) } > 5 RETURN n.n_nationkey AS k", "SELECT c_nationkey k FROM customer GROUP BY 1 HAVING count(*)>5")
_cypher("var_length_1_3", "MATCH (t:Turn)-[:NEXT_TURN*1..3]->(u:Turn) WHERE t.turn = 0 RETURN t.conv_id AS c, count(*) AS n, max(u.turn) AS last", "SELECT a.conv_id c, count(*) n, max(b.turn) AS last FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn BETWEEN 1 AND 3 WHERE a.turn=0 GROUP BY 1")
_cypher("path_length", "MATCH p = (t:Turn {turn: 0})-[:NEXT_TURN*1..2]->(u:Turn) RETURN t.conv_id AS c, length(p) AS hops, u.role AS role", "SELECT a.conv_id c, b.turn hops, b.role AS role FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn IN (1,2) WHERE a.turn=0")
_cypher("all_labels_count", "MATCH (n) RETURN label(n) AS label, count(*) AS n", " UNION ALL ".join(f"SELECT '{a}' AS label, count(*) n FROM {b}" for a, b in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Doc", "documents"), ("Label", "labels"), ("Turn", "conversations"))))
_cypher("all_rels_count", "MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS n", " UNION ALL ".join(f"SELECT '{a}' AS t, count(*) n FROM {b}" for a, b in (("IN_REGION", "nation"), ("LIVES_IN", "customer"), ("BASED_IN", "supplier"), ("PLACED", "orders"), ("HAS_PART", "lineitem"), ("SUPPLIED_BY", "lineitem"), ("HAS_LABEL", "labels"), ("NEXT_TURN", "conversations WHERE turn > 0"))))

_cypher("exists_under_or", "MATCH (c:Customer) WHERE c.c_acctbal > 9000 OR EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 } RETURN c.c_custkey AS k", "SELECT c_custkey k FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 250000)")
_cypher("pattern_predicate", "MATCH (p:Part) WHERE NOT (p)<-[:HAS_PART {quantity: 50.0}]-(:Order) AND p.p_size > 20 RETURN p.p_partkey AS k", "SELECT p_partkey k FROM part WHERE p_size > 20 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
_cypher("count_in_return", "MATCH (n:Nation) RETURN n.n_nationkey AS k, COUNT { (n)<-[:LIVES_IN]-(:Customer) } AS customers, EXISTS { (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 5000 } AS rich", "SELECT n_nationkey k, (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) customers, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=n_nationkey AND s_acctbal > 5000) rich FROM nation")
_cypher("map_projection", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n {.n_name, .n_regionkey, region: r.r_name, double: n.n_nationkey * 2} AS m RETURN m.n_name AS name, m.region AS region, m.double AS double", "SELECT n_name AS name, r_name region, n_nationkey * 2 AS double FROM nation JOIN region ON n_regionkey=r_regionkey")
_cypher("call_show_tables", "CALL SHOW_TABLES() RETURN *", "SELECT * FROM (VALUES ('Region','NODE'),('Nation','NODE'),('Customer','NODE'),('Supplier','NODE'),('Part','NODE'),('Order','NODE'),('Doc','NODE'),('Label','NODE'),('Turn','NODE'),('IN_REGION','REL'),('LIVES_IN','REL'),('BASED_IN','REL'),('PLACED','REL'),('HAS_PART','REL'),('SUPPLIED_BY','REL'),('HAS_LABEL','REL'),('NEXT_TURN','REL')) t(name, type)")
_cypher("call_table_info", "CALL TABLE_INFO('Customer') RETURN name, type, primary_key AS pk", "SELECT * FROM (VALUES ('c_custkey','INT64',true),('c_name','STRING',false),('c_nationkey','INT64',false),('c_acctbal','DOUBLE',false),('c_mktsegment','STRING',false)) t(name, type, pk)")
_cypher("open_path", "MATCH (t:Turn {turn: 0})-[:NEXT_TURN*]->(u:Turn) WHERE t.conv_id % 10 < 3 RETURN t.conv_id AS c, count(*) AS n", "SELECT conv_id c, count(*) n FROM conversations WHERE turn > 0 AND conv_id % 10 < 3 GROUP BY 1")
_cypher("undirected_walks", "MATCH (r:Region)-[:IN_REGION*2..3]-(x) RETURN r.r_regionkey AS k, label(x) AS label, count(*) AS n", "WITH d AS (SELECT n_regionkey r, count(*) c FROM nation GROUP BY 1) SELECT r k, 'Region' AS label, c n FROM d UNION ALL SELECT r, 'Nation', c * c FROM d")
_cypher("all_shortest", "MATCH p = allShortestPaths((a:Region {r_regionkey: 1})-[*1..2]-(c:Customer)) RETURN c.c_custkey AS k, length(p) AS hops, nodes(p)[1]._id AS via", "SELECT c_custkey k, 2::BIGINT hops, 'Nation:'||n_nationkey AS via FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=1")
_cypher("shortest_path", "MATCH p = (a:Turn)-[:NEXT_TURN* SHORTEST 1..3]->(b:Turn) WHERE a.turn = 1 RETURN a.conv_id AS c, b.turn AS t, length(p) AS hops", "SELECT a.conv_id c, b.turn t, b.turn - a.turn AS hops FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn - a.turn BETWEEN 1 AND 3 WHERE a.turn = 1")
_cypher(
    "shortest_between_groups",
    "MATCH p = allShortestPaths((c:Customer {c_nationkey: 3})-[:PLACED|SUPPLIED_BY*..4]-(s:Supplier {s_nationkey: 3})) RETURN c.c_custkey AS c, s.s_suppkey AS s, length(p) AS hops, count(*) AS paths",
    """WITH os AS (SELECT o_custkey c, l_suppkey s, count(*) n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 GROUP BY 1, 2),
g AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3),
d2 AS (SELECT c, s, n FROM os JOIN g ON s = s_suppkey),
ss AS (SELECT a.l_suppkey m, b.l_suppkey s, count(*) n FROM lineitem b JOIN g ON b.l_suppkey = s_suppkey JOIN lineitem a ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
SELECT c, s, 2::BIGINT AS hops, n AS paths FROM d2
UNION ALL SELECT os.c, ss.s, 4, sum(os.n * ss.n)::BIGINT FROM os JOIN ss ON os.s = ss.m ANTI JOIN d2 ON d2.c = os.c AND d2.s = ss.s GROUP BY 1, 2""",
)
_cypher(
    "shortest_between_pairs",
    "MATCH (a:Turn), (b:Turn) WHERE a.conv_id = b.conv_id AND a.turn = 0 AND b.turn >= 4 MATCH p = shortestPath((a)-[:NEXT_TURN*]->(b)) RETURN a.conv_id AS c, b.turn AS t, length(p) AS hops, nodes(p)[2]._id AS via",
    "SELECT a.conv_id c, b.turn t, b.turn AS hops, 'Turn:' || (a.conv_id * 10000 + 2) AS via FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn >= 4",
)
_cypher("optional_chain", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier)<-[:SUPPLIED_BY]-(o:Order) WHERE o.o_totalprice > 200000 RETURN n.n_nationkey AS k, count(DISTINCT s) AS suppliers, count(o) AS orders", "SELECT n_nationkey k, count(DISTINCT s_suppkey) suppliers, count(o_orderkey) orders FROM nation LEFT JOIN (SELECT s_nationkey, s_suppkey, o_orderkey FROM supplier JOIN lineitem ON l_suppkey=s_suppkey JOIN orders ON o_orderkey=l_orderkey AND o_totalprice > 200000) ON s_nationkey=n_nationkey GROUP BY 1")


# catalog

@_query("subgraph_nodes", "SELECT DISTINCT 'Nation:'||n_nationkey AS id, 'Nation' AS label FROM nation UNION ALL SELECT DISTINCT 'Region:'||n_regionkey, 'Region' FROM nation")
def subgraph_nodes(spark, folder):
    """The nodes that stand in the rows of a whole result, each once."""
    found = cypher(table_graph(spark, folder), "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n, r, x")
    return subgraph.subgraph_frames(found)[0].select("id", "label")


@_query("subgraph_edges", "SELECT 'IN_REGION:Nation:'||n_nationkey||'->Region:'||n_regionkey AS id, 'IN_REGION' AS type, 'Nation:'||n_nationkey AS src, 'Region:'||n_regionkey AS dst FROM nation")
def subgraph_edges(spark, folder):
    found = cypher(table_graph(spark, folder), "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n, r, x")
    return subgraph.subgraph_frames(found)[1]


@_query("laid_out_columns", "SELECT 'Nation:'||n_nationkey AS n, n_nationkey nk, n_name AS name, n_regionkey rk FROM nation")
def laid_out_columns(spark, folder):
    """Nodes of a result as columns of their properties."""
    wide = subgraph.laid_out(cypher(table_graph(spark, folder), "MATCH (n:Nation) RETURN n"))
    return wide.select("n", F.col("`n.n_nationkey`").alias("nk"), F.col("`n.n_name`").alias("name"), F.col("`n.n_regionkey`").alias("rk"))


@_query("subgraph_filter", "WITH n AS (SELECT n_nationkey, n_regionkey FROM nation JOIN region ON r_regionkey=n_regionkey WHERE contains('nation:'||n_nationkey, '1') OR contains(lower(n_name), '1') OR contains(n_nationkey::VARCHAR, '1') OR contains(n_regionkey::VARCHAR, '1')) SELECT 'Nation:'||n_nationkey AS src, 'Region:'||n_regionkey AS dst FROM n WHERE n_regionkey = 1 OR EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND contains(lower(r_name), '1'))")
def subgraph_filter(spark, folder):
    """Edges between the nodes that hold a text in their id or properties."""
    nodes, edges = subgraph.subgraph_frames(cypher(table_graph(spark, folder), "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n, r, x"))
    return subgraph.filtered(nodes, edges, "1")[1].select("src", "dst")


@_query("table_stats", " UNION ALL ".join(f"SELECT '{a}' AS name, 'node' AS kind, count(*) n FROM {b}" for a, b in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Doc", "documents"), ("Label", "labels"), ("Turn", "conversations"))) + "".join(f" UNION ALL SELECT '{a}', 'rel', count(*) FROM {b}" for a, b in (("IN_REGION", "nation"), ("LIVES_IN", "customer"), ("BASED_IN", "supplier"), ("PLACED", "orders"), ("HAS_PART", "lineitem"), ("SUPPLIED_BY", "lineitem"), ("HAS_LABEL", "labels"), ("NEXT_TURN", "conversations WHERE turn > 0"))))
def table_stats(spark, folder):
    return table_graph(spark, folder).table_stats()


@_query("sample_keys", "SELECT o_orderkey::VARCHAR AS key FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_keys(spark, folder):
    return table_graph(spark, folder).sample_keys("Order")


# text search

_BM25 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM documents),
t AS (SELECT doc_id, len(w) dl, {tfs} FROM d),
s AS (SELECT count(*) n, avg(dl) avgdl, {dfs} FROM t)
SELECT doc_id AS key, round({score}, 6) AS score FROM t, s WHERE {any}"""


def _bm25_sql(text: str, terms: list[str]) -> str:
    k = range(len(terms))
    part = "CASE WHEN tf{0} > 0 THEN ln(1 + (n - df{0} + 0.5) / (df{0} + 0.5)) * tf{0} * 2.2 / (tf{0} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
    return _BM25.format(text=text, tfs=", ".join(f"len(list_filter(w, lambda x: x = '{t}')) tf{i}" for i, t in enumerate(terms)), dfs=", ".join(f"sum((tf{i} > 0)::INT) df{i}" for i in k), score=" + ".join(part.format(i) for i in k), any=" OR ".join(f"tf{i} > 0" for i in k))


@_query("bm25_topk", _bm25_sql("text", ["the", "thand", "shand", "über"]) + " ORDER BY 2 DESC, 1 LIMIT 50")
def bm25_topk(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index, terms = textindex.index_for(docs, "doc_id", ["text"], textindex.shared_root(spark)), ["the", "thand", "shand", "über"]
    hits = index.search(terms, k=50) if index else bm.bm25(docs, "doc_id", ["text"], terms)
    hits = hits.select("key", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "key").limit(50)


@_query("bm25_multi_field", _bm25_sql("concat_ws(' ', text, lang, source)", ["fr", "src3", "les"]))
def bm25_multi_field(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return bm.bm25(docs, "doc_id", ["text", "lang", "source"], ["fr", "src3", "les"]).select("key", F.round("score", 6).alias("score"))


@_query("postings", "SELECT term, count(*) df, sum(tf)::BIGINT cf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) term, 1 tf FROM documents) GROUP BY doc_id, term".join(["SELECT term, count(*) df, sum(cf)::BIGINT cf FROM (", ") GROUP BY 1"]).replace("SELECT term, count(*) df, sum(tf)::BIGINT cf FROM (SELECT doc_id", "SELECT doc_id, term, sum(tf) cf FROM (SELECT doc_id"))
def postings(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return bm.postings(docs, "doc_id", ["text"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_NAMES = "n AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS name FROM benchmark WHERE regexp_full_match(array_to_string(string_split(text, ' ')[1:2], ' '), '[A-Za-z]+ [A-Za-z]+'))"


def _benchmark_names(spark, folder) -> DataFrame:
    first = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(F.lower(first).alias("name")).where(first.rlike("^[A-Za-z]+ [A-Za-z]+$")).distinct()


@_query("mention_join", f"WITH {_NAMES} SELECT doc_id AS key, name FROM documents, n WHERE contains(lower(text), name)")
def mention_join(spark, folder):
    """Which documents hold the first two words of which benchmark items, anywhere."""
    return mentions.contained(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", _benchmark_names(spark, folder), "name")


@_query("mention_words", f"WITH {_NAMES} SELECT doc_id AS key, name FROM documents, n WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || name || '($|[^\\p{{L}}\\p{{N}}_])')")
def mention_words(spark, folder):
    """The same as whole words, by an equi-join on words."""
    return mentions.mentioned(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", _benchmark_names(spark, folder), "name")


@_query("mention_patterns", "SELECT doc_id AS key, name FROM documents, (VALUES ('insult', '(?i)(^|[^\\p{L}\\p{N}_])(worthless|pathetic|stupid)($|[^\\p{L}\\p{N}_])'), ('license', '(?i)(^|[^\\p{L}\\p{N}_])(apache license|mit license)($|[^\\p{L}\\p{N}_])')) t(name, p) WHERE regexp_matches(text, p)")
def mention_patterns(spark, folder):
    """Which documents mention which things under any of their names."""
    aliases = {"insult": ["worthless", "pathetic", "stupid"], "license": ["Apache License", "MIT License"]}
    return mentions.pattern_mentions(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", aliases)


# vectors

_Q = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_QL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"
_COS = f"round(list_dot_product(embedding::DOUBLE[], {_QL}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QL}, {_QL}))), 6)"


def _vectors(spark, folder) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def _asked(spark, folder) -> DataFrame:
    """Every fiftieth vector as a query."""
    return _vectors(spark, folder).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@_query("cosine_scores", f"SELECT vec_id, {_COS} AS score FROM embeddings")
def cosine_scores(spark, folder):
    return _vectors(spark, folder).select("vec_id", F.round(vectors.cosine_with(F.col("embedding"), _Q), 6).alias("score"))


@_query("cosine_topk", f"SELECT vec_id AS key, {_COS} AS score FROM embeddings ORDER BY {_COS.removeprefix('round(').removesuffix(', 6)')} DESC, 1 LIMIT 20")
def cosine_topk(spark, folder):
    return vectors.top_k(_vectors(spark, folder), "vec_id", "embedding", _Q, 20).select("key", F.round("score", 6).alias("score"))


@_query("magnitude_split", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) r FROM embeddings")
def magnitude_split(spark, folder):
    return _vectors(spark, folder).select("vec_id", F.round(vectors.magnitude(F.col("embedding")), 6).alias("r"))


@_query("int8_scores", f"WITH s AS (SELECT vec_id, embedding::DOUBLE[] e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) m FROM embeddings) SELECT vec_id, round(list_dot_product(list_transform(e, lambda x: round_even(x * 127 / m, 0)::DOUBLE), {_QL}) / sqrt(list_dot_product({_QL}, {_QL})) * m / 127, 6) AS score FROM s")
def int8_scores(spark, folder):
    return _vectors(spark, folder).select("vec_id", F.round(vectors.int8_score(F.col("embedding"), _Q), 6).alias("score"))


@_query("hamming_scores", "SELECT vec_id, (" + " + ".join(f"(CASE WHEN (embedding[{i + 1}] >= 0) <> {str(x >= 0).upper()} THEN 1 ELSE 0 END)" for i, x in enumerate(_Q)) + ")::INT AS distance FROM embeddings")
def hamming_scores(spark, folder):
    return _vectors(spark, folder).select("vec_id", vectors.hamming(vectors.sign_bits(F.col("embedding")), [1 if x >= 0 else 0 for x in _Q]).alias("distance"))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_RESCORED = f"SELECT vec_id AS key, {_COS} AS score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM ({{shortlist}})) ORDER BY {_COS.removeprefix('round(').removesuffix(', 6)')} DESC, 1 LIMIT 10"
_INT8 = f"WITH s AS (SELECT vec_id, {_UNIT} e FROM embeddings) SELECT vec_id FROM s ORDER BY list_dot_product(list_transform(e, lambda x: round_even(x * 127 / list_max(list_transform(e, lambda y: abs(y))), 0)::DOUBLE), {_QL}) * list_max(list_transform(e, lambda y: abs(y))) DESC, vec_id LIMIT 40"
_BITS = "SELECT vec_id FROM embeddings ORDER BY " + " + ".join(f"(CASE WHEN (embedding[{i + 1}] >= 0) <> {str(x >= 0).upper()} THEN 1 ELSE 0 END)" for i, x in enumerate(_Q)) + ", vec_id LIMIT 40"


@_query("codec_recall")
def codec_recall(spark, folder):
    """For each codec the share of the ten nearest rows that a coded search finds, over every fiftieth row as a query."""
    table = codecs.with_codes(_vectors(spark, folder), "embedding", "int8", "int8_code", "r")
    asked = _asked(spark, folder)
    truth, out = codecs.batch_top_k(table, "vec_id", "embedding", asked, 10).persist(), None
    for codec in codecs.CODECS:
        found = codecs.batch_top_k(table, "vec_id", "embedding", asked, 10, codec, "int8_code" if codec == "int8" else None)
        one = codecs.recall(truth, found).select(F.lit(codec).alias("codec"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


@_query("batch_topk", f"WITH q AS (SELECT vec_id query, embedding::DOUBLE[] e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS key, list_dot_product(e, embedding::DOUBLE[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) score FROM q, embeddings) SELECT query, key, round(score, 5) score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, key) <= 5")
def batch_topk(spark, folder):
    """The five nearest rows of every fiftieth row."""
    return codecs.batch_top_k(_vectors(spark, folder), "vec_id", "embedding", _asked(spark, folder), 5).select("query", "key", F.round("score", 5).alias("score"))


def _vector_index(spark, folder):
    return vectorindex.index_for(_vectors(spark, folder), "vec_id", "embedding", textindex.shared_root(spark) or scratch_folder(spark))


@_query("ivf_topk", f"SELECT vec_id AS key, {_COS} AS score FROM embeddings ORDER BY {_COS.removeprefix('round(').removesuffix(', 6)')} DESC, 1 LIMIT 20")
def ivf_topk(spark, folder):
    """The nearest rows from the cells that can hold them: exact, without a scan."""
    return _vector_index(spark, folder).search(_Q, 20).select("key", F.round("score", 6).alias("score"))


@_query("ivf_recall", "SELECT count(*) AS queries, true AS enough, true AS fewer FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark, folder):
    """Of every fiftieth row as a query: whether its nearest cells, which are fewer than all, give nine of the ten nearest rows on the average."""
    table, index = _vectors(spark, folder), _vector_index(spark, folder)
    asked = _asked(spark, folder)
    truth = codecs.batch_top_k(table, "vec_id", "embedding", asked, 10)
    found = index.search_many(asked, 10)
    queries = asked.agg(F.count("*").alias("queries"))
    return queries.crossJoin(F.broadcast(codecs.recall(truth, found))).select("queries", (F.col("recall") >= 0.9).alias("enough"), F.lit(index.probes() < len(index.cells)).alias("fewer"))  # one row and one row


@_query("int8_rescore_topk", _RESCORED.format(shortlist=_INT8))
def int8_rescore_topk(spark, folder):
    return vectors.top_k(_vectors(spark, folder), "vec_id", "embedding", _Q, 10, "int8").select("key", F.round("score", 6).alias("score"))


@_query("binary_rescore_topk", _RESCORED.format(shortlist=_BITS))
def binary_rescore_topk(spark, folder):
    return vectors.top_k(_vectors(spark, folder), "vec_id", "embedding", _Q, 10, "binary").select("key", F.round("score", 6).alias("score"))


@_query("polar_rescore_topk")
def polar_rescore_topk(spark, folder):
    return vectors.top_k(_vectors(spark, folder), "vec_id", "embedding", _Q, 10, "polar").select("key", F.round("score", 6).alias("score"))


@_query("stored_codes", "SELECT vec_id, 68 AS code_bytes, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) r FROM embeddings")
def stored_codes(spark, folder):
    """Lengths and int8 codes as they are stored."""
    coded = codecs.with_codes(_vectors(spark, folder), "embedding", "int8")
    return coded.select("vec_id", F.octet_length("_emb_code").alias("code_bytes"), F.round("_emb_r", 5).alias("r"))


@_query("embed_pending", "SELECT doc_id, (doc_id % 4 = 0 OR doc_id < 2 * (SELECT count(*) FROM documents WHERE doc_id % 4 = 0)) AS has_vector FROM documents WHERE doc_id % 4 = 0")
def embed_pending(spark, folder):
    """Documents whose id is divisible by four lack vectors and get them; all have one then, of the embedder's size."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    waiting = embed.provision(docs, 64).withColumn("embedding", F.when(F.col("doc_id") % 4 != 0, F.array_repeat(F.lit(1.0).cast("float"), 64)))
    done = embed.embed_pending(waiting, "doc_id", embed.HashEmbedder(64), "int8")
    return done.where("_emb_model = 'hash-64'").select("doc_id", (F.size("embedding") == 64).alias("has_vector"))


@_query("polar_roundtrip")
def polar_roundtrip(spark, folder):
    """Cosine of each vector with what its angular code gives back."""
    import numpy as np

    from .functions import polar
    from .session import ship_package

    ship_package(spark)

    @F.pandas_udf("double")
    def kept(column: pd.Series) -> pd.Series:
        rows = np.stack([np.asarray(v, np.float64) for v in column])
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        back = polar.decode(polar.encode(rows, 4.0))
        return pd.Series((rows * back).sum(axis=1))

    return _vectors(spark, folder).select("vec_id", F.round(kept("embedding"), 4).alias("cosine"))


# fusion

def _lists(spark, folder) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    def ranked(order, n):
        top = orders.orderBy(order, "o_orderkey").limit(n)
        return top.select(F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.col("o_orderpriority").alias("label"), F.row_number().over(Window.orderBy(order, "o_orderkey")).alias("rank"))
    return ranked(F.desc("o_totalprice"), 60), ranked(F.desc("o_orderdate"), 60)


_LISTS = """WITH a AS (SELECT 'Order:'||o_orderkey node_id, o_orderpriority label, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) r FROM orders QUALIFY r <= 60),
b AS (SELECT 'Order:'||o_orderkey node_id, o_orderpriority label, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) r FROM orders QUALIFY r <= 60),
f AS (SELECT coalesce(a.node_id, b.node_id) node_id, coalesce(a.label, b.label) label, coalesce(1.0::DOUBLE/(60+a.r),0)+coalesce(1.0::DOUBLE/(60+b.r),0) score, CASE WHEN a.r IS NOT NULL AND (b.r IS NULL OR a.r<=b.r) THEN 'fts' ELSE 'vector' END AS match, a.r ar, b.r br FROM a FULL JOIN b ON a.node_id=b.node_id),
g AS (SELECT *, row_number() OVER (ORDER BY score DESC, ar NULLS LAST, br NULLS LAST, node_id) fused_rank FROM f)"""


@_query("rrf_fusion", _LISTS + " SELECT node_id, label, round(score, 8) score, match, fused_rank::INT fused_rank FROM g")
def rrf_fusion(spark, folder):
    return retrieve.fuse(*_lists(spark, folder)).withColumn("score", F.round("score", 8))


@_query("diversity_cap", _LISTS + ", h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fused_rank) > 2 held FROM g) SELECT node_id, label, row_number() OVER (ORDER BY held, fused_rank)::INT seed_rank FROM h ORDER BY held, fused_rank LIMIT 8")
def diversity_cap(spark, folder):
    return retrieve.diversify(retrieve.fuse(*_lists(spark, folder))).select("node_id", "label", "seed_rank")


_EDGES = "e AS (SELECT 'Nation:'||n_nationkey s, 'Region:'||n_regionkey d FROM nation UNION ALL SELECT 'Customer:'||c_custkey, 'Nation:'||c_nationkey FROM customer UNION ALL SELECT 'Supplier:'||s_suppkey, 'Nation:'||s_nationkey FROM supplier UNION ALL SELECT 'Customer:'||o_custkey, 'Order:'||o_orderkey FROM orders UNION ALL SELECT DISTINCT 'Order:'||l_orderkey, 'Part:'||l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'Order:'||l_orderkey, 'Supplier:'||l_suppkey FROM lineitem UNION ALL SELECT 'Doc:'||doc_id, 'Label:'||doc_id FROM labels UNION ALL SELECT 'Turn:'||(conv_id*10000+turn-1), 'Turn:'||(conv_id*10000+turn) FROM conversations WHERE turn > 0)"
_TWO_HOPS = f"WITH RECURSIVE {_EDGES}, u AS (SELECT s a, d b FROM e UNION ALL SELECT d, s FROM e), w AS (SELECT 'Region:1' n, 0 depth UNION SELECT b, depth + 1 FROM w JOIN u ON n = a WHERE depth < 2), m AS (SELECT n node_id, min(depth) depth FROM w GROUP BY 1) "


@_query("khop_nodes", _TWO_HOPS + "SELECT node_id, depth::INT depth FROM m")
def khop_nodes(spark, folder):
    graph = table_graph(spark, folder)
    seeds = spark.createDataFrame([("Region:1",)], "node_id string")
    return retrieve.expand(graph, seeds, 2)[0]


@_query("khop_by_lists", _TWO_HOPS + "SELECT node_id, depth::INT depth FROM m")
def khop_by_lists(spark, folder):
    """The same by stored neighbour lists."""
    graph = table_graph(spark, folder)
    state = adjacency.write_lists(graph.edges(), scratch_folder(spark))
    seeds = spark.createDataFrame([("Region:1",)], "node_id string")
    return retrieve.expand(graph, seeds, 2, lists=adjacency.Adjacency(spark, state))[0]


@_query("khop_edges", _TWO_HOPS + "SELECT DISTINCT s AS src, d AS dst FROM e WHERE s IN (SELECT node_id FROM m WHERE depth < 2) OR d IN (SELECT node_id FROM m WHERE depth < 2)")
def khop_edges(spark, folder):
    graph = table_graph(spark, folder)
    seeds = spark.createDataFrame([("Region:1",)], "node_id string")
    return retrieve.expand(graph, seeds, 2)[1].select("src", "dst").distinct()


@_query("shortest_hops", "SELECT 'Turn:'||(conv_id*10000+turn) AS node_id, turn::INT hops FROM conversations WHERE turn <= 4 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)")
def shortest_hops(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    ident = lambda shift=0: F.concat(F.lit("Turn:"), (F.col("conv_id") * 10000 + F.col("turn") + shift).cast("string"))
    edges = turns.where("turn > 0").select(ident(-1).alias("src"), ident().alias("dst"))
    return retrieve.shortest_hops(edges, turns.where("turn = 0").select(ident().alias("node_id")), 4)


_HYBRID_TERMS = ["thand", "shand", "worthless"]
_HYBRID = ("WITH d AS" + _bm25_sql("text", _HYBRID_TERMS).split("WITH d AS")[1]).replace("SELECT doc_id AS key, round(", ", bm AS (SELECT doc_id AS key, round(").replace(", 6) AS score FROM t, s", ", 12) AS score FROM t, s")
_HYBRID += f"""),
vt AS (SELECT doc_id AS key, list_dot_product(embedding::DOUBLE[], {_QL}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QL}, {_QL}))) AS score FROM documents JOIN embeddings ON vec_id = doc_id),
fa AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) r FROM bm QUALIFY r <= 8),
fb AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) r FROM vt QUALIFY r <= 8),
fu AS (SELECT coalesce(fa.key, fb.key) AS key, coalesce(1.0::DOUBLE/(60+fa.r),0) + coalesce(1.0::DOUBLE/(60+fb.r),0) AS score, CASE WHEN fa.r IS NOT NULL AND (fb.r IS NULL OR fa.r <= fb.r) THEN 'fts' ELSE 'vector' END AS match, fa.r ar, fb.r br FROM fa FULL JOIN fb ON fa.key = fb.key),
se AS (SELECT 'Doc:'||key AS node_id, 'Doc' AS label, round(score, 8) score, match, row_number() OVER (ORDER BY score DESC, ar NULLS LAST, br NULLS LAST, 'Doc:'||key) AS seed_rank FROM fu QUALIFY seed_rank <= 8)"""


def _searched(spark, folder, hops: int) -> retrieve.SearchResult:
    """A search of documents that have vectors in a table of their own, and of their labels: both halves of the search and a hop of expansion have work to do.

    The text index is that of the documents' texts; vectors are compared beside the documents' keys alone, so that no text is joined or sorted.
    """
    graph, docs = table_graph(spark, folder), spark.read.parquet(f"{folder}/documents.parquet")
    coded = _vectors(spark, folder).join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    graph.add_nodes("Doc", graph.nodes["Doc"].withColumn("embedding", F.lit(None).cast("array<float>")), "doc_id", searchable=True)
    text_index = lambda label: textindex.index_for(docs, "doc_id", ["text"], textindex.shared_root(spark) or scratch_folder(spark))
    nearest = lambda label, query, k: vectors.top_k(coded, "vec_id", "embedding", query, k)
    return retrieve.search(graph, " ".join(_HYBRID_TERMS), _Q, labels=["Doc"], hops=hops, text_index=text_index, nearest=nearest)


@_query("hybrid_seeds", _HYBRID + " SELECT node_id, label, score, match, seed_rank::INT seed_rank FROM se")
def hybrid_seeds(spark, folder):
    return _searched(spark, folder, 0).seeds.select("node_id", "label", F.round("score", 8).alias("score"), "match", "seed_rank")


@_query("hybrid_nodes", _HYBRID + " SELECT node_id, 0 AS depth FROM se UNION ALL SELECT 'Label:'||doc_id, 1 FROM labels WHERE 'Doc:'||doc_id IN (SELECT node_id FROM se)")
def hybrid_nodes(spark, folder):
    """The seeds and what lies a hop around them."""
    return _searched(spark, folder, 1).nodes


# writing


def _stored_documents(spark, folder, indexed: bool) -> GraphService:
    """Documents in a store, of which every fiftieth then gets another text and every hundredth goes, by deltas; ``indexed`` before those, if anyone searches them."""
    service = GraphService(GraphStore(spark, scratch_folder(spark)))
    service.define_schema([NodeTable("Doc", "doc_id", {"text": "STRING", "lang": "STRING"}, True)], key_types={"Doc": "INT64"})
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    service.store.replace({"Doc": docs.withColumns({"_source": F.lit(None).cast("string"), "_created_at": F.lit(None).cast("timestamp")})})
    if indexed:
        service._text_index("Doc")
    service.upsert_nodes("Doc", docs.where("doc_id % 50 = 1").select("doc_id", F.concat(F.lit("thand "), F.substring("text", 1, 200)).alias("text")))
    service.store.merge({"Doc": docs.where("doc_id % 100 = 7").select("doc_id").withColumn(DELETED, F.lit(True))})
    return service


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'thand ' || substr(text, 1, 200) ELSE text END AS text, lang FROM documents WHERE doc_id % 100 <> 7)"


@_query("delta_rows", f"SELECT doc_id, sha256(text) AS text_sha256, lang FROM {_CHANGED}")
def delta_rows(spark, folder):
    """A stored table after two small writes: its base and two deltas, merged on reading."""
    return _stored_documents(spark, folder, False).store.table("Doc").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang")


@_query("delta_topk", _bm25_sql("concat_ws(' ', text, lang)", ["thand", "shand", "über"]).replace("FROM documents", f"FROM {_CHANGED}") + " ORDER BY 2 DESC, 1 LIMIT 50")
def delta_topk(spark, folder):
    """The best rows by an index of three segments: the table's and those of the two writes."""
    index = _stored_documents(spark, folder, True)._text_index("Doc")
    return index.search(["thand", "shand", "über"], k=50).orderBy(F.desc("score"), "key").limit(50).select("key", F.round("score", 6).alias("score"))


@_query("upsert_merge", "SELECT coalesce(c.c_custkey, b.k) c_custkey, coalesce(b.name, c.c_name) c_name, c.c_nationkey, coalesce(b.bal, c.c_acctbal) c_acctbal, c.c_mktsegment FROM customer c FULL JOIN (SELECT s_suppkey*3 k, CASE WHEN s_suppkey%2=0 THEN s_name END AS name, s_acctbal bal FROM supplier) b ON c.c_custkey=b.k")
def upsert_merge(spark, folder):
    customers, suppliers = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("customer", "supplier"))
    batch = suppliers.select((F.col("s_suppkey") * 3).alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_suppkey").alias(mutate.ORDINAL))
    return mutate.upsert(customers, batch, ["c_custkey"])


@_query("upsert_last_wins", "SELECT o_custkey k, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 <> 0) price, arg_max(o_orderstatus, o_orderkey) status FROM orders GROUP BY 1")
def upsert_last_wins(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    batch = orders.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias(mutate.ORDINAL))
    return mutate.last_supplied(batch, ["k"], ["price", "status"])


@_query("merge_edges_collapse", "SELECT l_orderkey _src, l_partkey _dst, arg_max(l_quantity, l_linenumber*1000000000000 + l_suppkey*1000000 + l_quantity) quantity FROM lineitem GROUP BY 1, 2")
def merge_edges_collapse(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    order = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_suppkey") * 1000000 + F.col("l_quantity")
    return mutate.last_supplied(lines.select(F.col("l_orderkey").alias("_src"), F.col("l_partkey").alias("_dst"), F.col("l_quantity").alias("quantity"), order.alias(mutate.ORDINAL)), ["_src", "_dst"], ["quantity"])


@_query("prune_stale", "SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND doc_id % 4 <> 0)")
def prune_stale(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("source").alias("_source"))
    kept, _ = mutate.prune(docs, docs.where("doc_id % 4 = 0"), "doc_id", "src3")
    return kept.select("doc_id")


@_query("embedding_invalidation", "SELECT doc_id, (doc_id % 5 <> 0) AS has_vector FROM documents")
def embedding_invalidation(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", F.lit(1.0).alias("embedding"))
    changed = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang")))
    return mutate.invalidate_embeddings(docs, changed, "doc_id", ["lang"], ["embedding"]).select("doc_id", F.col("embedding").isNotNull().alias("has_vector"))


@_query("prune_prefix", "SELECT 'd'||doc_id||'#'||lpad(n::VARCHAR, 4, '0') AS id FROM documents, range(3) t(n) WHERE NOT (doc_id % 5 = 0 AND n = 2)")
def prune_prefix(spark, folder):
    """Of chunks whose document is ingested again those go that it no longer gives."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("own"), "doc_id")
    chunks = docs.select("own", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).select("own", "doc_id", "n", F.concat("own", F.format_string("#%04d", "n")).alias("id"))
    again = chunks.where("doc_id % 5 = 0")
    return mutate.prune_prefix(chunks, again.where("n < 2"), "id", again.select(F.col("own").alias("prefix")))[0].select("id")


@_query("detach_delete", "SELECT l_orderkey _src, l_partkey _dst, count(*) n FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_partkey % 11 <> 0 GROUP BY 1, 2")
def detach_delete(spark, folder):
    """Relationships that are left when nodes at both ends are deleted."""
    graph = table_graph(spark, folder)
    rels = mutate.detach(graph.rels["HAS_PART"], graph.nodes["Order"].where("o_orderkey % 7 = 0"), "o_orderkey", ["_src"])
    rels = mutate.detach(rels, graph.nodes["Part"].where("p_partkey % 11 = 0"), "p_partkey", ["_dst"])
    return rels.groupBy("_src", "_dst").agg(F.count("*").alias("n"))


@_query("set_values", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def set_values(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    return mutate.set_values(customers, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit(None), "c_acctbal": F.lit(0.0)}).select("c_custkey", "c_mktsegment", "c_acctbal")


@_query("coerced_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_partkey END::BIGINT AS size, (p_size * 2)::DOUBLE AS price FROM part")
def coerced_upsert(spark, folder):
    """Text and whole numbers are taken where they read as the declared type, the rest is left out with a warning."""
    parts = spark.read.parquet(f"{folder}/part.parquet")
    table = parts.select("p_partkey", F.col("p_size").cast("long").alias("size"), "p_retailprice").withColumnRenamed("p_retailprice", "price")
    text = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string")))
    batch = parts.select("p_partkey", text.alias("size"), (F.col("p_size") * 2).alias("price"), F.lit(True).alias("undeclared"), F.lit(0).alias(mutate.ORDINAL))
    clean, warnings = mutate.sanitize(batch, table, ["p_partkey"])
    assert len(warnings) == 2, warnings
    return mutate.upsert(table, clean, ["p_partkey"])


@_query("anti_missing_endpoints", "SELECT doc_id*2 AS _src, doc_id AS _dst, 'source' AS missing FROM labels WHERE doc_id*2 NOT IN (SELECT doc_id FROM documents)")
def anti_missing_endpoints(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    return mutate.missing_endpoints(labels.select((F.col("doc_id") * 2).alias("_src"), F.col("doc_id").alias("_dst")), docs, "doc_id", docs, "doc_id")


# documents, lines and context

@_query("token_estimates", "SELECT doc_id, length(text)//4 AS tokens FROM documents")
def token_estimates(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", pack.token_estimate(F.col("text")).alias("tokens"))


@_query("node_lines", "SELECT 'Nation:'||n_nationkey AS node_id, 'Nation:'||n_nationkey||' {n_nationkey: '||n_nationkey||', n_name: \"'||n_name||'\", n_regionkey: '||n_regionkey||'}' AS line FROM nation")
def node_lines(spark, folder):
    return pack.rendered_nodes(spark.read.parquet(f"{folder}/nation.parquet"), "Nation", "n_nationkey")


@_query("source_identity", "SELECT doc_id, source||'-'||sha256(source) AS id FROM documents")
def source_identity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", chunk.identity(F.col("source"), F.col("text"), F.lit(None).cast("string")).alias("id"))


@_query("chunk_documents")
def chunk_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return chunk.chunk_documents(docs.select("text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("string").alias("metadata"), F.col("doc_id").alias("ordinal"))).select("id", F.length("text").alias("chars"), "_source")


@_query("pack_context")
def pack_context(spark, folder):
    graph = table_graph(spark, folder)
    nodes = pack.rendered_nodes(graph.nodes["Nation"], "Nation", "n_nationkey").orderBy("node_id").limit(25).collect()
    text, truncated = pack.pack([r["line"] for r in nodes], 200)
    return spark.createDataFrame([(text, truncated)], "context string, truncated boolean")


_GOLDEN = ["CONTAINS_REPO_MODULE repo repo:pkg/__init__.py", "CONTAINS_REPO_MODULE repo repo:pkg/base.py", "CONTAINS_REPO_MODULE repo repo:pkg/more.py", "CONTAINS_MODULE_CLASS repo:pkg/base.py repo:pkg/base.py#Base", "CONTAINS_MODULE_CLASS repo:pkg/more.py repo:pkg/more.py#More", "CONTAINS_CLASS_FUNCTION repo:pkg/base.py#Base repo:pkg/base.py#Base.run", "CONTAINS_CLASS_FUNCTION repo:pkg/base.py#Base repo:pkg/base.py#Base.step", "CONTAINS_MODULE_FUNCTION repo:pkg/base.py repo:pkg/base.py#helper", "CONTAINS_CLASS_FUNCTION repo:pkg/more.py#More repo:pkg/more.py#More.go", "IMPORTS repo:pkg/more.py repo:pkg/base.py", "INHERITS repo:pkg/more.py#More repo:pkg/base.py#Base", "CALLS repo:pkg/base.py#Base.run repo:pkg/base.py#Base.step", "CALLS repo:pkg/base.py#Base.step repo:pkg/base.py#helper", "CALLS repo:pkg/more.py#More.go repo:pkg/base.py#helper"]


@_query("code_graph", "SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(line.split(" ")) + "')" for line in _GOLDEN) + ") t(type, src, dst)")
def code_graph(spark, folder):
    files = spark.createDataFrame(
        [
            ("pkg/__init__.py", ""),
            ("pkg/base.py", "class Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return helper()\n\ndef helper():\n    return 1\n"),
            ("pkg/more.py", "from .base import Base, helper\n\nclass More(Base):\n    def go(self):\n        return helper()\n"),
        ],
        "path string, source string",
    )
    return codegraph.code_graph(files)[1].select("type", "src", "dst")


_EXPORTED = [("customer", "Customer"), ("documents", "Doc"), ("labels", "Label"), ("nation", "Nation"), ("orders", "Order"), ("part", "Part"), ("region", "Region"), ("supplier", "Supplier"), ("conversations", "Turn")]
_EXPORTED_RELS = [("supplier", "BASED_IN"), ("labels", "HAS_LABEL"), ("lineitem", "HAS_PART"), ("nation", "IN_REGION"), ("customer", "LIVES_IN"), ("conversations WHERE turn > 0", "NEXT_TURN"), ("orders", "PLACED"), ("lineitem", "SUPPLIED_BY")]


@_query("export_jsonl", " UNION ALL ".join(["SELECT 'graph_export' AS type, NULL AS name, 1 AS lines", "SELECT 'schema', NULL, 1", *(f"SELECT 'node', '{n}', count(*) FROM {t}" for t, n in _EXPORTED), *(f"SELECT 'edge', '{n}', count(*) FROM {t}" for t, n in _EXPORTED_RELS)]))
def export_jsonl(spark, folder):
    """The lines of an export by what they say they are."""
    lines = export_lines(table_graph(spark, folder))
    field = lambda name: F.get_json_object("line", f"$.{name}")
    return lines.groupBy(field("type").alias("type"), F.coalesce(field("label"), field("rel")).alias("name")).agg(F.count("*").alias("lines"))


@_query("export_lines", "SELECT 'Nation' AS label, n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def export_nations(spark, folder):
    """What the exported lines of a table hold, read back."""
    lines = export_lines(table_graph(spark, folder)).where(F.get_json_object("line", "$.label") == "Nation")
    read = lines.select(F.from_json("line", "struct<label: string, key: int, properties: struct<n_name: string, n_regionkey: int>>").alias("r"))
    return read.select("r.label", "r.key", F.col("r.properties.n_name").alias("name"), F.col("r.properties.n_regionkey").alias("region"))
