"""Queries over the driver tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import bloom, keys, text
from veldspar.functions import vector as V
from veldspar.operators import dml, fulltext, graph, rag, relational, stats, vectors
from veldspar.operators.predicates import Condition
from veldspar.plans import statements
from veldspar.plans.facade import Database
from veldspar.sources import sinks
from veldspar.sources.tables import KEYS, all_nodes, edges, id_of, node_ids, nodes, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scans and lookups
@query("SELECT 'part:' || p_partkey AS id, 'part' AS type, p_brand, p_name, p_partkey, p_retailprice, p_size, p_type FROM part")
def sc1_scan_type(spark, sf):
    return relational.project(nodes(spark, sf, "part"))


@query("SELECT 'customer:' || c_custkey AS id, c_name FROM customer ORDER BY id LIMIT 10")
def sc2_scan_limit_by_id(spark, sf):
    return relational.by_type(nodes(spark, sf, "customer"), "customer", 10).select("id", "c_name")


@query("SELECT 'customer:' || c_custkey AS id, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def sc3_index_lookup(spark, sf):
    return relational.select(nodes(spark, sf, "customer"), ["c_acctbal"], [Condition("c_mktsegment", "=", "BUILDING")]).drop("type")


@query("SELECT 'orders:' || o_orderkey AS id, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def sc5_point_lookup(spark, sf):
    return relational.get(nodes(spark, sf, "orders"), "orders:7").select("id", "o_orderstatus", "o_totalprice")


@query("SELECT 'nation:' || n_nationkey AS id, 'nation' AS type, CAST((n_nationkey IS NOT NULL)::INT + (n_name IS NOT NULL)::INT + (n_regionkey IS NOT NULL)::INT AS INT) AS property_count FROM nation")
def sc6_node_metadata(spark, sf):
    return relational.metadata(nodes(spark, sf, "nation")).select("id", "type", "property_count")


@query("""SELECT 'in_nation' AS edge_type, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'in_region', count(*) FROM nation UNION ALL SELECT 'placed', count(*) FROM orders""")
def sc8_edges_by_type(spark, sf):
    return edges(spark, sf).where("edge_type <> 'next_turn'").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pos, id, c_name FROM (VALUES (0, 'customer:5'), (1, 'customer:3'), (2, 'customer:none'), (3, 'customer:5')) a(pos, id) LEFT JOIN (SELECT 'customer:' || c_custkey AS id, c_name FROM customer) USING (id)")
def sc9_multi_get(spark, sf):
    return relational.multi_get(spark, nodes(spark, sf, "customer"), ["customer:5", "customer:3", "customer:none", "customer:5"]).select("pos", "id", "c_name")


@query("SELECT 'customer' AS type, c_name, NULL AS s_name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'supplier', NULL, s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000")
def sc10_union_of_types(spark, sf):
    a = nodes(spark, sf, "customer").select("type", "c_name", F.col("c_acctbal").alias("balance"))
    b = nodes(spark, sf, "supplier").select("type", "s_name", F.col("s_acctbal").alias("balance"))
    return relational.union_types([a, b], [Condition("balance", ">", 9000.0)]).select("type", "c_name", "s_name", "balance")


@query("SELECT c_name FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000020'")
def sc12_key_range(spark, sf):
    return relational.key_range(read(spark, sf, "customer").select("c_name"), "c_name", "Customer#000000010", "Customer#000000020")


@query("SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def sc13_prefix_scan(spark, sf):
    return relational.prefix_scan(read(spark, sf, "customer").select("c_name"), "c_name", "Customer#0000000")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def so1_json_properties(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT 'region:' || r_regionkey AS id, r_name FROM region")
def so1_schemaless_nodes(spark, sf):
    from veldspar.sources.tables import untyped

    return untyped(nodes(spark, sf, "region")).select("id", F.expr("variant_get(properties, '$.r_name', 'string')").alias("r_name"))


@query("""WITH m AS (SELECT event_id, strlen(props) AS size, ts FROM events),
r AS (SELECT event_id, size, (SELECT sum(size) FROM m) - coalesce(sum(size) OVER (ORDER BY ts, 'e:' || event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM m)
SELECT 'e:' || event_id AS id, CAST(size AS BIGINT) AS payload_size FROM r WHERE remaining > 0.8 * 5000""")
def so5_eviction_candidates(spark, sf):
    meta = read(spark, sf, "events").select(F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("id"), F.octet_length("props").cast("long").alias("payload_size"), F.col("ts").alias("updated_at"))
    return stats.eviction_candidates(meta, 5000, 0).select("id", "payload_size")


@query("""SELECT printf('  "nation:%d" -> "region:%d" [label="in_region"];', n_nationkey, n_regionkey) AS line FROM nation""")
def sk4_dot_lines(spark, sf):
    return sinks.dot(edges(spark, sf, types=["in_region"]))


# Predicates, projection, order
@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL")
def p1_filter_eq_nullsafe(spark, sf):
    return _segments(spark, sf, Condition("segment", "=", None))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'")
def p2_filter_ne_keeps_null(spark, sf):
    return _segments(spark, sf, Condition("segment", "!=", "MACHINERY"))


def _segments(spark, sf, condition):
    from veldspar.operators.predicates import where

    return where(read(spark, sf, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment")), [condition])


@query("SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, id LIMIT 100")
def p3_filter_range(spark, sf):
    found = [Condition("c_acctbal", ">", 5000), Condition("c_mktsegment", "=", "BUILDING")]
    return relational.select(nodes(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"], found, [("c_acctbal", True), ("id", False)], 100)


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%S_A%'")
def p4_filter_like(spark, sf):
    from veldspar.operators.predicates import where

    return where(read(spark, sf, "part").select("p_partkey", "p_type"), [Condition("p_type", "LIKE", "%S_A%")])


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IN ('MACHINERY', 'AUTOMOBILE') OR nullif(c_mktsegment, 'BUILDING') IS NULL")
def p5_filter_in_with_null(spark, sf):
    return _segments(spark, sf, Condition("segment", "IN", ("MACHINERY", "AUTOMOBILE", None)))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def p6_filter_is_null(spark, sf):
    return _segments(spark, sf, Condition("segment", "IS NULL"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
def p7_filter_is_not_null(spark, sf):
    return _segments(spark, sf, Condition("segment", "IS NOT NULL"))


@query("SELECT 'orders:' || o_orderkey AS id, 'orders' AS type, o_orderpriority FROM orders WHERE 'orders:' || o_orderkey <> 'orders:1'")
def p10_project_forced_id_type(spark, sf):
    return relational.select(nodes(spark, sf, "orders"), ["o_orderpriority"], [Condition("id", "!=", "orders:1"), Condition("type", "=", "orders")])


@query("SELECT DISTINCT split_part('customer:' || o_custkey, ':', 2) AS bare FROM orders")
def p13_node_id(spark, sf):
    return read(spark, sf, "orders").select(keys.node_id(id_of("customer", "o_custkey")).alias("bare")).distinct()


@query("SELECT 'orders:' || o_orderkey AS id, 'orders' AS type, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS FIRST, o_totalprice DESC NULLS LAST, id LIMIT 20 OFFSET 5")
def s2_order_multi_limit_offset(spark, sf):
    order = [("o_orderpriority", False), ("o_totalprice", True), ("id", False)]
    return relational.select(nodes(spark, sf, "orders"), ["o_orderpriority", "o_totalprice"], (), order, 20, 5)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def s6_keyset_page(spark, sf):
    return relational.page(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


# Graph
@query("SELECT 'customer:' || c_custkey AS id, c_name, c_nationkey, c_acctbal FROM customer")
def g5_kv_view(spark, sf):
    kv = relational.key_values(nodes(spark, sf, "customer"))
    v = F.from_json("value", "c_name string, c_nationkey int, c_acctbal double")
    return kv.select("id", v.alias("v")).select("id", "v.c_name", "v.c_nationkey", "v.c_acctbal")


@query("SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'in_nation' AS edge_type FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'placed' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def g5_graph_view_edges(spark, sf):
    return graph.graph_view(edges(spark, sf), nodes(spark, sf, "customer"))


@query("SELECT 'orders:' || o_orderkey AS dst, 'placed' AS edge_type FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'nation:' || c_nationkey, 'in_nation' FROM customer WHERE c_custkey = 1")
def g6_neighbors_out(spark, sf):
    return edges(spark, sf, src=["customer:1"]).select("dst", "edge_type")


@query("SELECT 'customer:' || c_custkey AS src FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3")
def g6_neighbors_in(spark, sf):
    return edges(spark, sf, dst=["nation:3"]).select("src")


@query("SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS neighbours FROM nation")
def a10_adjacency(spark, sf):
    return stats.adjacency(edges(spark, sf, types=["in_region"])).select("src", F.array_join("neighbours", ",").alias("neighbours"))


def _out(spark, sf):
    return lambda ids: edges(spark, sf, src=ids)


_E = """WITH RECURSIVE e(src, dst, kind) AS (
  SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'in_region' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'placed' FROM orders),
"""


@query(_E + "r(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def g1_bfs_depth2(spark, sf):
    return graph.traverse(spark, node_ids(spark, sf, False), edges(spark, sf), ["customer:1"], 2, edges_from=_out(spark, sf)).nodes


@query(_E + "r(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3 AND e.kind <> 'placed'), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT e.src, e.dst, e.kind AS edge_type FROM e JOIN d ON d.id = e.src WHERE d.depth < 3 AND e.kind <> 'placed'")
def g7_bfs_edge_filter(spark, sf):
    return graph.traverse(spark, node_ids(spark, sf, False), edges(spark, sf), ["customer:1"], 3, ["in_nation", "in_region"], edges_from=_out(spark, sf)).edges.select("src", "dst", "edge_type")


@query(_E + "r(id, depth) AS (SELECT * FROM (VALUES ('customer:1', 0), ('customer:2', 0)) UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def g4_multi_source_bfs(spark, sf):
    return graph.traverse(spark, node_ids(spark, sf, False), edges(spark, sf), ["customer:1", "customer:2"], 2, edges_from=_out(spark, sf)).nodes


@query("SELECT 'customer:1>nation:' || c_nationkey || '>region:' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def g2_shortest_path(spark, sf):
    start = read(spark, sf, "customer").where("c_custkey = 1").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()
    found = graph.shortest_path(spark, edges(spark, sf), "customer:1", f"region:{start['n_regionkey']}", 5)
    return spark.createDataFrame([(">".join(found or []),)], "path string")


@query("""WITH place AS (
  SELECT 'region:' || r_regionkey AS id, r_regionkey AS g FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'orders:' || o_orderkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
talk AS (SELECT 'conversations:' || conv_id || ':' || turn AS id, conv_id, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT id, min(id) OVER (PARTITION BY g) AS component FROM place UNION ALL SELECT id, min(id) OVER (PARTITION BY conv_id, g) FROM talk""")
def g3_components(spark, sf):
    return graph.components(node_ids(spark, sf), edges(spark, sf))


# Aggregates
@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS node_count, (SELECT count(*) FROM orders) AS edge_count, 2 AS schema_count")
def a1_status(spark, sf):
    both = nodes(spark, sf, "customer").select("id", "type").union(nodes(spark, sf, "orders").select("id", "type"))
    return stats.status(both, edges(spark, sf, types=["placed"]))


_T = r"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS w FROM documents),
tokens AS (SELECT doc_id, lower(w) AS token FROM words WHERE strlen(w) > 1 AND lower(w) NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """)),
post AS (SELECT token, doc_id, count(*) AS tf FROM tokens GROUP BY ALL)
"""


def _documents(spark, sf):
    return nodes(spark, sf, "documents")


@query(_T + "SELECT token, 'documents:' || doc_id AS id, tf FROM post")
def a2_fts_postings(spark, sf):
    return fulltext.postings(_documents(spark, sf).select("id", "text"), "text").select("token", "id", "tf")


@query(_T + "SELECT token, count(*) AS df FROM post GROUP BY token")
def a3_fts_df(spark, sf):
    return fulltext.document_frequency(fulltext.postings(_documents(spark, sf).select("id", "text"), "text"))


@query(_T + """, n AS (SELECT count(*) AS n FROM documents), q(token, times) AS (VALUES ('tion', 2), ('thing', 1), ('hat', 1)),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
s AS (SELECT doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * tf / (tf + 1.2)) AS score FROM post JOIN q USING (token) JOIN df USING (token), n GROUP BY doc_id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, 'documents:' || doc_id) AS INT) AS rank, 'documents:' || doc_id AS id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 10""")
def t2_fts_bm25_topk(spark, sf):
    found = statements.parse("FULLTEXT SEARCH documents FIELD text FOR 'tion thing the hat tion' LIMIT 10")
    hits = fulltext.search(_documents(spark, sf).select("id", "type", "text"), found.field, found.query, found.limit)
    return hits.select("rank", "id", F.round("score", 6).alias("score"))


@query("""SELECT CAST(i - 1 AS INT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, generate_series(1, 64) g(i) GROUP BY i""")
def a5_vector_centroid(spark, sf):
    return stats.centroid(read(spark, sf, "embeddings").select("embedding"), "embedding").select("pos", F.round("mean", 6).alias("mean"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def a6_vocabulary(spark, sf):
    return stats.vocabulary(read(spark, sf, "documents").select("text"), "text", 50)


@query()
def a7_shard_stats(spark, sf):
    return stats.shards(nodes(spark, sf, "orders").select("id"))


@query("SELECT count(*) AS num_vectors, CAST(sum(n) AS BIGINT) AS total_connections, round(avg(n), 6) AS avg_connections, max(n) AS max_connections FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def a8_connection_stats(spark, sf):
    return stats.graph_stats(edges(spark, sf, types=["placed"])).withColumn("avg_connections", F.round("avg_connections", 6))


# Vectors
def _vectors(spark, sf):
    return nodes(spark, sf, "embeddings")


def _first_vector(spark, sf):
    return read(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]


_Q = "WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), p AS (SELECT 'embeddings:' || vec_id AS id, label, {} AS x FROM embeddings, q) "
_TOP = "SELECT CAST(row_number() OVER (ORDER BY {0} DESC, id) AS INT) AS rank, id, round({0}, 6) AS score, round({1}, 6) AS distance FROM p {2} ORDER BY rank LIMIT 10"
_COS = "list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[])"
_L2 = "sqrt(list_sum(list_transform(generate_series(1, len(v)), lambda i: pow((embedding[i] - v[i])::FLOAT::DOUBLE, 2))))"
_L1 = "list_sum(list_transform(generate_series(1, len(v)), lambda i: abs((embedding[i] - v[i])::FLOAT::DOUBLE)))"
_DOT = "list_inner_product(embedding::DOUBLE[], v::DOUBLE[])"


def _top(spark, sf, metric, conditions=()):
    found = vectors.search(_vectors(spark, sf), "embedding", _first_vector(spark, sf), 10, metric, conditions)
    return found.select("rank", "id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query(_Q.format(_COS) + _TOP.format("x", "1 - x", ""))
def v1_vector_topk_cosine(spark, sf):
    return _top(spark, sf, "cosine")


@query(_Q.format(_L2) + _TOP.format("(1 / (1 + x))", "x", ""))
def v1_vector_topk_euclidean(spark, sf):
    return _top(spark, sf, "l2")


@query(_Q.format(_DOT) + _TOP.format("x", "-x", ""))
def v1_vector_topk_dot(spark, sf):
    return _top(spark, sf, "inner")


@query(_Q.format(_L1) + _TOP.format("(1 / (1 + x))", "x", ""))
def v1_vector_topk_manhattan(spark, sf):
    return _top(spark, sf, "l1")


@query(_Q.format(_COS) + "SELECT id, round(x, 6) AS score FROM p WHERE 1 - x <= 0.8")
def v2_vector_radius(spark, sf):
    found = vectors.search_radius(_vectors(spark, sf), "embedding", _first_vector(spark, sf), 0.8)
    return found.select("id", F.round("score", 6).alias("score"))


@query(_Q.format(_L2) + _TOP.format("(1 / (1 + x))", "x", "WHERE label >= 3 AND label <> 5"))
def v6_vector_filtered(spark, sf):
    q = ", ".join(map(repr, map(float, _first_vector(spark, sf))))
    found = statements.parse(f"VECTOR SEARCH embeddings FIELD embedding FOR [{q}] METRIC euclidean WHERE label >= 3 AND label != 5 LIMIT 10")
    hits = vectors.search(_vectors(spark, sf), found.field, found.query, found.limit, found.metric, found.conditions)
    return hits.select("rank", "id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query()
def v3_hyperplane_search(spark, sf):
    return vectors.HyperplaneIndex(_vectors(spark, sf), "embedding", 64).search(_first_vector(spark, sf), 10).select("rank", "id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings")
def f5_normalize(spark, sf):
    v = read(spark, sf, "embeddings")
    unit = v.select("vec_id", "embedding", V.normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("u")), 5).alias("length"))


@query("SELECT vec_id, CAST(255 AS INT) AS high, CAST(0 AS INT) AS low, true AS close FROM embeddings")
def f7_quantize(spark, sf):
    v = read(spark, sf, "embeddings").withColumn("q", V.quantize(F.col("embedding"))).withColumn("back", V.dequantize(F.col("q")))
    error = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b)))
    return v.select("vec_id", F.array_max("q.codes").alias("high"), F.array_min("q.codes").alias("low"), (error <= (F.col("q.high") - F.col("q.low")) / 509).alias("close"))


# Retrieval
_TERMS = ("tion", "thing", "hat")
_TF = "(length(lower(text)) - length(replace(lower(text), '{0}', ''))) // length('{0}')"
_PART = "CASE WHEN {0} > 0 THEN {0} * 2.5 / ({0} + 1.5 * (0.25 + 0.75 * length(text) / 500.0)) ELSE 0 END"
_KEY = " + ".join(_PART.format(_TF.format(t)) for t in _TERMS)


@query(f"SELECT doc_id, round({_KEY}, 6) AS score FROM documents")
def f11_keyword_score(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(text.keyword_score(F.col("text"), _TERMS), 6).alias("score"))


@query("SELECT doc_id, round((" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in _TERMS) + ") / 3.0, 6) AS overlap, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def f12_keyword_overlap(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(text.keyword_overlap(F.col("text"), " ".join(_TERMS)), 6).alias("overlap"), text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, round(least(({_KEY}) / 3.0, 1.0), 6) AS score FROM documents")
def f13_bm25_rerank(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(text.bm25_rerank(F.col("text"), " ".join(_TERMS)), 6).alias("score"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents),
s AS (SELECT *, CASE WHEN n <= 512 THEN 0 ELSE ceil((n - 512) / 462.0)::INT END AS last FROM n WHERE n > 0),
c AS (SELECT *, unnest(generate_series(0, last)) AS i FROM s)
SELECT doc_id || '_' || i AS chunk_id, md5(substr(text, i * 462 + 1, 512)) AS digest, CAST(last + 1 AS INT) AS total_chunks,
  CAST(strlen(substr(text, 1, i * 462)) AS BIGINT) AS start_offset, CAST(strlen(substr(text, 1, i * 462)) + strlen(substr(text, i * 462 + 1, 512)) AS BIGINT) AS end_offset FROM c""")
def r1_chunk_fixed(spark, sf):
    chunks = rag.chunk_fixed(read(spark, sf, "documents"), id_col="doc_id", text_col="text")
    return chunks.select("chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"), "total_chunks", "start_offset", "end_offset")


@query()
def r2_chunk_sentences(spark, sf):
    return rag.chunk_sentences(read(spark, sf, "documents"), id_col="doc_id", text_col="text").select("chunk_id", "total_chunks", "start_offset", "end_offset")


@query()
def r3_chunk_paragraphs(spark, sf):
    return rag.chunk_paragraphs(read(spark, sf, "documents"), id_col="doc_id", text_col="text").select("chunk_id", "total_chunks", "start_offset", "end_offset")


@query()
def r4_chunk_sections(spark, sf):
    return rag.chunk_sections(read(spark, sf, "documents"), id_col="doc_id", text_col="text").select("chunk_id", "total_chunks", "start_offset", "end_offset")


def _passages(spark, sf):
    """Documents with the vector of the same number, where there is one."""
    docs, vecs = read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "embeddings").select("vec_id", "embedding")
    return docs.join(vecs, F.col("doc_id") == F.col("vec_id"), "left").select(id_of("documents", "doc_id").alias("id"), "text", "embedding")


_PASSAGES = f"WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT 'documents:' || doc_id AS id, text, {_COS} AS sim, {_KEY} AS key FROM documents LEFT JOIN embeddings ON doc_id = vec_id, q), "


@query(_PASSAGES + """k AS (SELECT id, row_number() OVER (ORDER BY key DESC, id) AS keyword_rank FROM d WHERE key > 0 QUALIFY keyword_rank <= 30),
s AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS vector_rank FROM d WHERE sim IS NOT NULL QUALIFY vector_rank <= 30),
b AS (SELECT id, coalesce(0.5 / (60 + keyword_rank), 0) + coalesce(0.5 / (60 + vector_rank), 0) AS score FROM k FULL JOIN s USING (id))
SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, id, round(score, 8) AS score FROM b ORDER BY rank LIMIT 10""")
def r10_hybrid_rrf(spark, sf):
    found = rag.hybrid(_passages(spark, sf), "text", "embedding", " ".join(_TERMS), _first_vector(spark, sf), 10)
    return found.select("rank", "id", F.round("score", 8).alias("score"))


@query(_PASSAGES + """b AS (SELECT id, text, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM d WHERE sim IS NOT NULL QUALIFY rank <= 40),
t AS (SELECT CAST(rank AS INT) AS rank, id, round(sim, 6) AS score, CAST(sum(length(text) // 4) OVER (ORDER BY rank) AS BIGINT) AS total_tokens FROM b WHERE sim >= 0.05) SELECT * FROM t WHERE total_tokens <= 4000""")
def r12_context_budget(spark, sf):
    found = rag.retrieve(_passages(spark, sf), "embedding", _first_vector(spark, sf), 4000, 0.05, "text")
    return found.select("rank", "id", F.round("score", 6).alias("score"), "total_tokens")


@query(_PASSAGES + """b AS (SELECT id, text, sim, least(key / 3.0, 1.0) AS again FROM d WHERE sim IS NOT NULL ORDER BY sim DESC, id LIMIT 80),
r AS (SELECT id, text, 0.5 * sim + 0.5 * again AS score, row_number() OVER (ORDER BY 0.5 * sim + 0.5 * again DESC, id) AS rank FROM b WHERE sim >= 0.05),
t AS (SELECT CAST(rank AS INT) AS rank, id, round(score, 6) AS score, CAST(sum(length(text) // 4) OVER (ORDER BY rank) AS BIGINT) AS total_tokens FROM r) SELECT * FROM t WHERE total_tokens <= 4000""")
def r13_context_reranked(spark, sf):
    found = rag.retrieve(_passages(spark, sf), "embedding", _first_vector(spark, sf), 4000, 0.05, "text", lambda c: text.bm25_rerank(c, " ".join(_TERMS)))
    return found.select("rank", "id", F.round("score", 6).alias("score"), "total_tokens")


@query()
def r16_ingest(spark, sf):
    made = rag.ingest(read(spark, sf, "benchmark"), rag.HashEmbedder(32), id_col="item_id", text_col="text")
    return made.select("chunk_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"))


# Changes
@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def d3_update(spark, sf):
    table = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return dml.update(table, {"c_mktsegment": "OVERDRAWN"}, [Condition("c_acctbal", "<", 0)]).drop("c_acctbal")


@query("SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def d4_delete_cascade(spark, sf):
    own = edges(spark, sf).where("edge_type = 'placed' OR src LIKE 'customer:%'")
    return dml.delete_nodes(nodes(spark, sf, "customer"), own, [Condition("c_acctbal", "<", 0)])[1].select("src", "dst")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def d2_insert(spark, sf):
    return dml.insert(read(spark, sf, "region"), spark.createDataFrame([(99, "ATLANTIS")], "r_regionkey int, r_name string"))


# Operators in the shapes that callers see
@query("SELECT id, type FROM (SELECT 'region:' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'orders:' || o_orderkey, 'orders' FROM orders UNION SELECT 'conversations:' || conv_id || ':' || turn, 'conversations' FROM conversations)")
def sc7_all_nodes(spark, sf):
    return node_ids(spark, sf)


@query("SELECT 'orders:' || o_orderkey AS id, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j4_posting_semi_join(spark, sf):
    listed = relational.select(nodes(spark, sf, "customer"), ["c_custkey"], [Condition("c_mktsegment", "=", "MACHINERY")])
    return nodes(spark, sf, "orders").join(listed, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("id", "o_totalprice")


@query("SELECT 'part:' || p_partkey AS id, 'part' AS type, p_size, p_type FROM part WHERE p_size >= 10 AND p_size < 20 AND p_type LIKE '%A%'")
def p8_filter_and(spark, sf):
    conditions = [Condition("p_size", ">=", 10), Condition("p_size", "<", 20), Condition("p_type", "LIKE", "%A%")]
    return relational.select(nodes(spark, sf, "part"), ["p_size", "p_type"], conditions)


@query("SELECT 'nation:' || n_nationkey AS id, 'nation' AS type, n_name FROM nation WHERE n_nationkey IN (3, 4)")
def p9_pseudo_columns(spark, sf):
    return relational.select(nodes(spark, sf, "nation"), ["n_name"], [Condition("type", "=", "nation"), Condition("id", "IN", ["nation:3", "nation:4", "region:1"])])


@query("SELECT 'supplier:' || s_suppkey AS id, 'supplier' AS type, nullif(s_nationkey, 7) AS k FROM supplier ORDER BY k ASC NULLS FIRST, id LIMIT 12")
def s1_order_nulls_lowest(spark, sf):
    own = nodes(spark, sf, "supplier").select("id", "type", F.expr("nullif(s_nationkey, 7) AS k"))
    return relational.select(own, ["k"], (), [("k", False), ("id", False)], 12)


@query(_Q.format(_COS) + f""", m AS (SELECT vec_id, {_L2} AS l2, {_L1} AS l1, {_DOT} AS ip, {_COS} AS cos FROM embeddings, q)
SELECT vec_id, metric, round(score, 6) AS score, round(distance, 6) AS distance FROM (
SELECT vec_id, 'cosine' AS metric, cos AS score, 1 - cos AS distance FROM m UNION ALL SELECT vec_id, 'euclidean', 1 / (1 + l2), l2 FROM m
UNION ALL SELECT vec_id, 'manhattan', 1 / (1 + l1), l1 FROM m UNION ALL SELECT vec_id, 'dot', ip, -ip FROM m)""")
def f6_scores_and_distances(spark, sf):
    own, first = read(spark, sf, "embeddings"), V.literal(_first_vector(spark, sf))
    pairs = [F.struct(F.lit(m).alias("metric"), *[c.alias(n) for c, n in zip(V.score_and_distance(F.col("embedding"), first, m), ("score", "distance"), strict=True)]) for m in ("cosine", "euclidean", "manhattan", "dot")]
    return own.select("vec_id", F.explode(F.array(*pairs)).alias("x")).select("vec_id", "x.metric", F.round("x.score", 6).alias("score"), F.round("x.distance", 6).alias("distance"))


@query(_T + "SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_tokens FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) USING (doc_id)")
def f8_tokens(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(_T + "SELECT token, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), (SELECT count(*) AS n FROM documents)")
def f9_idf(spark, sf):
    docs = _documents(spark, sf).select("id", "text")
    found = fulltext.document_frequency(fulltext.postings(docs, "text"))
    return found.select("token", F.round(text.idf(F.lit(docs.count()), F.col("df")), 6).alias("idf"))


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, CAST(user_id AS DOUBLE) AS real FROM events")
def f16_coercions(spark, sf):
    return read(spark, sf, "events").select("event_id", keys.as_int(F.col("value")).alias("whole"), keys.as_float(F.col("user_id")).alias("real"))


@query("SELECT p_partkey, 's:' || p_brand AS s, 'i:' || p_size AS i, printf('f:%.10f', p_retailprice) AS f, CASE WHEN p_size > 20 THEN 'b:true' ELSE 'b:false' END AS b FROM part")
def f17_property_keys(spark, sf):
    values = {"s": F.col("p_brand"), "i": F.col("p_size"), "f": F.col("p_retailprice"), "b": F.col("p_size") > 20}
    return read(spark, sf, "part").select("p_partkey", *[keys.property_key(v, k).alias(k) for k, v in values.items()])


@query("SELECT c_custkey, true AS found FROM customer")
def f19_bloom_holds_all(spark, sf):
    """A filter of fixed size forgets nothing that was put in."""
    own = read(spark, sf, "customer").select("c_custkey", "c_name")
    made = bloom.build(own, "c_name", 200_000)
    has = F.pandas_udf(lambda names: names.map(lambda x: x in made), "boolean")
    return own.select("c_custkey", has("c_name").alias("found"))


@query("SELECT '    ' || substr('nation:' || n_nationkey, 1, 8) || ' -->|in_region| ' || substr('region:' || n_regionkey, 1, 8) AS line FROM nation")
def g8_mermaid_lines(spark, sf):
    return sinks.mermaid(edges(spark, sf, types=["in_region"]))


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def sk2_json_rows(spark, sf):
    return sinks.json_rows(read(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey"))


@query(_Q.format(_COS) + "SELECT CAST(row_number() OVER (ORDER BY x DESC, id) AS INT) AS rank, id AS node_id, printf('%.6f', x) AS score, printf('%.6f', 1 - x) AS distance FROM p ORDER BY rank LIMIT 10")
def sk5_similarity_rows(spark, sf):
    return sinks.similarity_rows(vectors.search(_vectors(spark, sf), "embedding", _first_vector(spark, sf), 10))


@query(_T + "SELECT count(DISTINCT doc_id) AS indexed FROM post")
def t1_fts_index_count(spark, sf):
    return spark.createDataFrame([(fulltext.indexed_documents(_documents(spark, sf).select("id", "text"), "text"),)], "indexed long")


@query(_T + """, q(token, times) AS (VALUES ('hat', 1)), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
s AS (SELECT doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * tf / (tf + 1.2) AS score FROM post JOIN q USING (token) JOIN df USING (token), n),
b AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, 'documents:' || doc_id) AS INT) AS rank, doc_id, score FROM s QUALIFY rank <= 5)
SELECT rank, 'documents:' || doc_id AS id, 'documents' AS type, round(score, 6) AS score, doc_id, lang, source FROM b JOIN documents USING (doc_id)""")
def t3_fts_result_shape(spark, sf):
    hits = fulltext.search(_documents(spark, sf), "text", "the hat", 5)
    return hits.select("rank", "id", "type", F.round("score", 6).alias("score"), "doc_id", "lang", "source")


_WORDS = ("the", "und", "que")


@query("WITH w AS (SELECT doc_id, " + ", ".join(f"len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x = '{w}')) AS c{i}" for i, w in enumerate(_WORDS)) + " FROM documents), n AS (SELECT *, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS l FROM w) SELECT doc_id, " + ", ".join(f"CASE WHEN l = 0 THEN 0.0::DOUBLE ELSE round(c{i} / l, 4) END AS v{i}" for i in range(3)) + " FROM n")
def r7_term_vectors(spark, sf):
    made = read(spark, sf, "documents").select("doc_id", rag.TermEmbedder(_WORDS).column(F.col("text")).alias("v"))
    return made.select("doc_id", *[F.round(F.col("v")[i].cast("double"), 4).alias(f"v{i}") for i in range(3)])


@query("SELECT 'documents:' || doc_id AS id, (" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in _TERMS) + ") / 3.0 AS s FROM documents WHERE s > 0 ORDER BY s DESC, id LIMIT 25")
def r11_keyword_search(spark, sf):
    return rag.keyword_search(_documents(spark, sf), "text", " ".join(_TERMS), 25).withColumnRenamed("score", "s")


@query(_PASSAGES + """b AS (SELECT text, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM d WHERE sim IS NOT NULL QUALIFY rank <= 40),
t AS (SELECT *, sum(length(text) // 4) OVER (ORDER BY rank) AS total FROM b WHERE sim >= 0.05)
SELECT md5(string_agg('[Source ' || rank || '] (Relevance: ' || printf('%.2f', sim) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM t WHERE total <= 4000""")
def r15_format_for_llm(spark, sf):
    found = rag.retrieve(_passages(spark, sf), "embedding", _first_vector(spark, sf), 4000, 0.05, "text")
    return rag.format_for_llm(found).select(F.md5(F.col("text").cast("binary")).alias("digest"))


@query(" UNION ".join(f"SELECT '{kind}:' || {" || ':' || ".join(key)} AS id, '{kind}' AS type FROM {kind}" for kind, key in KEYS.items()))
def sc7_all_types(spark, sf):
    return all_nodes(spark, sf)


@query("SELECT 'conversations:' || a.conv_id || ':' || a.turn AS src, 'conversations:' || b.conv_id || ':' || b.turn AS dst FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def sc8_next_turns(spark, sf):
    return edges(spark, sf, types=["next_turn"]).select("src", "dst")


@query("SELECT 'customer:' || o_custkey AS src, 'orders:' || o_orderkey AS dst, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS note FROM orders UNION ALL SELECT 'customer:1', 'customer:2', NULL, 'friend'")
def sc8_edge_properties(spark, sf):
    db = Database(spark)
    own = read(spark, sf, "orders")
    db.register_edges(own.select(id_of("customer", "o_custkey").alias("src"), id_of("orders", "o_orderkey").alias("dst"), F.lit("placed").alias("edge_type"), F.col("o_totalprice").alias("amount")))
    db.create_edge("customer:1", "customer:2", "knows", {"note": "friend"})
    return db.edges.select("src", "dst", "amount", "note")


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'orders:' || o_orderkey AS id FROM orders LIMIT 500)")
def sc11_shard_scan(spark, sf):
    """Never fewer than the limit, however the shards are filled."""
    found = relational.shard_scan(nodes(spark, sf, "orders").select("id", "type"), 16, 500)
    return found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT 'part:' || p_partkey AS id, p_name FROM part WHERE p_partkey IN (3, 5)")
def sc5_pushed_lookups(spark, sf):
    own = nodes(spark, sf, "part")
    return relational.get(own, "part:3").union(relational.get(own, "part:5")).select("id", "p_name")


@query("SELECT 'nation' AS type, count(*) AS node_count, (SELECT count(*) FROM nation) AS edge_count FROM nation")
def a7_shard_totals(spark, sf):
    """The totals over all shards; every shard's row is counted in them."""
    both = stats.shard_totals(nodes(spark, sf, "nation"), edges(spark, sf, types=["in_region"]), 4)
    parts, total = both.where("shard IS NOT NULL"), both.where("shard IS NULL")
    sums = parts.agg(F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("links"))
    same = (F.col("nodes") == F.col("node_count")) & (F.col("links") == F.col("edge_count"))
    return total.crossJoin(F.broadcast(sums)).where(same).select(F.lit("nation").alias("type"), "node_count", "edge_count")  # one row and one row


@query("SELECT CASE WHEN strlen(props) <= 8 THEN 'hot' ELSE 'cold' END AS tier, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def a9_tiered_stats(spark, sf):
    return stats.tiered(read(spark, sf, "events").select(F.octet_length("props").cast("long").alias("payload_size")), 8)


@query("""SELECT 'nation:' || n_nationkey AS id, CAST(strlen('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS INT) AS payload_size FROM nation""")
def sc6_payload_size(spark, sf):
    return relational.metadata(nodes(spark, sf, "nation")).select("id", "payload_size")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, CASE WHEN c_acctbal < 0 THEN concat('debt, ', c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer")
def d3_update_sql(spark, sf):
    db = Database(spark)
    db.register("customer_copy", read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").withColumn("id", F.col("c_custkey").cast("string")))
    db.query("UPDATE customer_copy SET c_mktsegment = concat('debt, ', c_mktsegment), c_acctbal = round(c_acctbal, 2) WHERE c_acctbal < 0")
    return db.types["customer_copy"].select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


@query("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (98, 'LEMURIA, EAST'), (99, 'ATLANTIS') UNION ALL SELECT r_regionkey + 100, 'NEW ' || r_name FROM region WHERE r_regionkey < 2")
def d2_insert_sql(spark, sf):
    db = Database(spark)
    db.register("region_copy", read(spark, sf, "region").select("r_regionkey", "r_name").withColumn("id", F.col("r_regionkey").cast("string")))
    db.query("INSERT INTO region_copy (r_regionkey, r_name) VALUES (98, 'LEMURIA, EAST'), (99, 'ATLANTIS')")
    db.query("INSERT INTO region_copy (r_regionkey, r_name) SELECT r_regionkey + 100, concat('NEW ', r_name) FROM region_copy WHERE r_regionkey < 2")
    return db.types["region_copy"].select("r_regionkey", "r_name")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
def d4_delete_sql(spark, sf):
    db = Database(spark)
    db.register("orders_copy", read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("id", F.col("o_orderkey").cast("string")))
    db.query("DELETE FROM orders_copy WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
    return db.types["orders_copy"].select("o_orderkey")


@query(_Q.format(_COS) + _TOP.format("x", "1 - x", "WHERE label = 1 OR label BETWEEN 4 AND 6"))
def v6_vector_filtered_or(spark, sf):
    q = ", ".join(map(repr, map(float, _first_vector(spark, sf))))
    db = Database(spark)
    db.register("embeddings_copy", _vectors(spark, sf))
    hits = db.query(f"VECTOR SEARCH embeddings_copy FIELD embedding FOR [{q}] WHERE label = 1 OR label BETWEEN 4 AND 6 LIMIT 10")
    return hits.select("rank", "id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query(_T + """, q AS (SELECT token, n AS times FROM (SELECT token, 1 AS n, count(*) AS df FROM post GROUP BY token ORDER BY df DESC, token LIMIT 3)), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
s AS (SELECT doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * tf / (tf + 1.2)) AS score FROM post JOIN q USING (token) JOIN df USING (token), n GROUP BY doc_id),
b AS (SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, 'documents:' || doc_id) AS INT) AS rank, doc_id, score FROM s QUALIFY rank <= 5)
SELECT rank, 'documents:' || doc_id AS id, 'documents' AS type, round(score, 6) AS score, doc_id, lang, source FROM b JOIN documents USING (doc_id)""")
def t3_fts_stored_index(spark, sf):
    """The three most frequent tokens, looked up in a stored index."""
    index = fulltext.StoredIndex(_documents(spark, sf), "text")
    often = fulltext.document_frequency(index.postings).orderBy(F.desc("df"), "token").limit(3).collect()
    hits = index.search(" ".join(r["token"] for r in often), 5)
    return hits.select("rank", "id", "type", F.round("score", 6).alias("score"), "doc_id", "lang", "source")


@query("SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(round((embedding[i] - list_min(embedding))::DOUBLE / (list_max(embedding) - list_min(embedding))::DOUBLE * 255) AS INT) AS code FROM embeddings, generate_series(1, 64) g(i)")
def f7_quantized_codes(spark, sf):
    own = read(spark, sf, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    return own.select("vec_id", F.posexplode("q.codes").alias("pos", "code")).select("vec_id", F.col("pos").cast("int").alias("pos"), F.col("code").cast("int").alias("code"))


@query("SELECT count(*) AS inside, true AS few_others FROM customer")
def f19_bloom_rate(spark, sf):
    """All keys of the table are found, and under 3 % of as many others."""
    own = read(spark, sf, "customer").select("c_name")
    n = own.count()
    made = bloom.build(own, "c_name", max(1, n))
    probes = own.withColumn("kind", F.lit(0)).union(own.select(F.concat(F.lit("other "), "c_name"), F.lit(1)))
    found = probes.where(made.has(F.col("c_name"))).agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("inside"), F.sum("kind").alias("others"))
    return found.select(F.col("inside").cast("long").alias("inside"), (F.col("others") < 0.03 * n + 1).alias("few_others"))


def _packed(pieces: str, fits: str, joint: int) -> str:
    """SQL of greedy packing: pieces (doc_id, i, chars, bytes) in order, joined with ``joint`` characters while ``fits``."""
    return f"""WITH RECURSIVE {pieces},
r(doc_id, i, k, c, b) AS (SELECT doc_id, i, 0, chars, bytes FROM pieces WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN {fits} THEN r.k ELSE r.k + 1 END, CASE WHEN {fits} THEN r.c + p.chars + {joint} ELSE p.chars END, CASE WHEN {fits} THEN r.b + p.bytes + {joint} ELSE p.bytes END
  FROM r JOIN pieces p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
c AS (SELECT doc_id, k, max(b) AS b FROM r GROUP BY doc_id, k)
SELECT doc_id || '_' || k AS chunk_id, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks,
  CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY k) - b AS BIGINT) AS start_offset, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS end_offset FROM c"""


_PIECES = r"split AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, {} AS x FROM documents)), trimmed AS (SELECT doc_id, j, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM split), pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, length(p) AS chars, strlen(p) AS bytes FROM trimmed WHERE p <> '')"


@query(_packed(_PIECES.format(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"), "(r.c + p.chars) // 4 <= 128", 1))
def r2_sentences_packed(spark, sf):
    return r2_chunk_sentences(spark, sf)


@query(_packed(_PIECES.format("string_split(text, chr(10) || chr(10))"), "r.b + p.bytes + 2 <= 1000", 2))
def r3_paragraphs_packed(spark, sf):
    return r3_chunk_paragraphs(spark, sf)


@query("""WITH n AS (SELECT item_id, text, length(text) AS n FROM benchmark WHERE length(text) > 0), s AS (SELECT *, CASE WHEN n <= 512 THEN 0 ELSE ceil((n - 512) / 462.0)::INT END AS last FROM n)
SELECT item_id || '_' || i AS chunk_id, md5(substr(text, i * 462 + 1, 512)) AS digest, CAST(32 AS INT) AS size, 1.0::DOUBLE AS length FROM (SELECT *, unnest(generate_series(0, last)) AS i FROM s)""")
def r16_ingested_chunks(spark, sf):
    made = rag.ingest(read(spark, sf, "benchmark"), rag.HashEmbedder(32), id_col="item_id", text_col="text")
    length = F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 4)
    return made.select("chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"), F.size("embedding").alias("size"), length.alias("length"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def x_set_except_rows(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def x_set_union(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def x_set_intersect(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(read(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


# Extensions: what Spark SQL gives beside the operators above
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def x_group_aggregate(spark, sf):
    df = read(spark, sf, "lineitem")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x_join_aggregate(spark, sf):
    both = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS n FROM orders QUALIFY n <= 3")
def x_window_top3(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("n")).where("n <= 3")


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def x_set_except(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(read(spark, sf, "supplier").select("s_nationkey"))
