import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.functions import text
from veldspar.functions import vector as V
from veldspar.functions.bloom import Bloom, CountingBloom, build
from veldspar.operators import graph, rag, vectors
from veldspar.operators.predicates import Condition, where, where_present
from veldspar.plans import schema, statements
from veldspar.plans.facade import Database
from veldspar.sources import sinks
from veldspar.streaming.results import ResultStream, append, node_stream


@pytest.fixture(scope="module")
def ring(spark):
    nodes = spark.createDataFrame([(f"v{i}", "vertex") for i in range(10)], "id string, type string")
    edges = spark.createDataFrame([(f"v{i}", f"v{(i + d) % 10}", "links") for i in range(10) for d in (1, 2)], "src string, dst string, edge_type string")
    return nodes, edges


def test_traverse(spark, ring):
    nodes, edges = ring
    found = graph.traverse(spark, nodes, edges, ["v0"], 2)
    assert {(r["id"], r["depth"]) for r in found.nodes.collect()} == {("v0", 0), ("v1", 1), ("v2", 1), ("v3", 2), ("v4", 2)}
    assert found.edges.count() == 6
    with pytest.raises(ValueError):
        graph.traverse(spark, nodes, edges, ["none"], 1)


def test_dangling_self_and_parallel_edges(spark):
    nodes = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "id string, type string")
    edges = spark.createDataFrame([("a", "a", "e"), ("a", "b", "e"), ("a", "b", "e"), ("b", "gone", "e")], "src string, dst string, edge_type string")
    assert {r["id"] for r in graph.traverse(spark, nodes, edges, ["a"], 5).nodes.collect()} == {"a", "b"}
    assert {tuple(r) for r in graph.components(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {tuple(r) for r in graph.components(nodes, edges, "u").collect()} == {("c", "c")}


def test_shortest_path(spark, ring):
    _, edges = ring
    assert graph.shortest_path(spark, edges, "v0", "v4", 5) == ["v0", "v2", "v4"]
    assert graph.shortest_path(spark, edges, "v0", "v0") == ["v0"]
    assert graph.shortest_path(spark, edges, "v0", "v9", 2) is None


def test_long_chain_is_one_component(spark):
    n = 40
    nodes = spark.createDataFrame([(f"{i:03}", "t") for i in range(n)], "id string, type string")
    edges = spark.createDataFrame([(f"{(i * 7) % n:03}", f"{((i + 1) * 7) % n:03}", "e") for i in range(n - 1)], "src string, dst string, edge_type string")
    assert {r["component"] for r in graph.components(nodes, edges).collect()} == {"000"}


def test_null_rules(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, s string")
    keys = lambda c, f=where: sorted(r["k"] for r in f(df, [c]).collect())
    assert keys(Condition("s", "=", None)) == [2]
    assert keys(Condition("s", "!=", "x")) == [2, 3]
    assert keys(Condition("s", "!=", "x"), where_present) == [3]
    assert keys(Condition("s", "IN", ("x", None))) == [1, 2]
    assert keys(Condition("s", "NOT IN", ("x",))) == [2, 3]
    assert keys(Condition("s", "<", "z")) == [1, 3]
    with pytest.raises(ValueError):
        Condition("s", "~", 1).expression()


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], "a"), ([0.0, 1.0, 0.0], "b"), ([-1.0, 0.0, 0.0], "c"), ([0.0, 0.0, 0.0], "zero"), ([1.0], "short"), (None, "none")], "v array<float>, id string").withColumn("type", F.lit("doc"))
    got = {r["id"]: r["score"] for r in vectors.search(df, "v", [1, 0, 0], 10).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": -1.0}
    assert [r["id"] for r in vectors.search_radius(df, "v", [1, 0, 0], 1.5, "l2").collect()] == ["a", "zero", "b"]
    q = df.where("id = 'zero'").select(V.quantize(F.col("v")).alias("q")).first()["q"]
    assert list(q["codes"]) == [128, 128, 128]


def test_hyperplanes_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.lit("e").alias("type"), "embedding")
    index, hits = vectors.HyperplaneIndex(df, "embedding", 64), 0
    for r in df.orderBy("id").limit(3).collect():
        exact = {x["id"] for x in vectors.search(df, "embedding", r["embedding"], 10).collect()}
        hits += len(exact & {x["id"] for x in index.search(r["embedding"], 10).collect()})
    assert hits >= 27


def test_tokens(spark):
    df = spark.createDataFrame([("The Cat's 2nd é run-of a",), (None,), ("",)], "t string")
    assert [list(r[0]) for r in df.select(text.tokens(F.col("t"))).collect()] == [["cat", "2nd", "é", "run"], [], []]
    assert text.query_tokens("The Cat, a CAT") == ["cat", "cat"]


def test_chunkers(spark):
    assert rag.pack_sentences("One two. Three four! Five?", 2) == [("One two.", 0, 8), ("Three four!", 8, 19), ("Five?", 19, 24)]
    assert rag.pack_sentences("One two. Three four! Five?", 5) == [("One two. Three four!", 0, 20), ("Five?", 20, 25)]
    assert [c for c, *_ in rag.pack_paragraphs("aa\n\nbb\n\n\n\ncccc", 6)] == ["aa\n\nbb", "cccc"]
    assert [c for c, *_ in rag.pack_sections("# A\nx\n# B\ny", 100)] == ["# A\nx", "# B\ny"]
    df = spark.createDataFrame([("d", "é" * 10), ("e", ""), ("n", None)], "id string, content string")
    got = rag.chunk_fixed(df, 4, 1).orderBy("chunk_index").collect()
    assert [(r["content"], r["start_offset"], r["end_offset"]) for r in got] == [("éééé", 0, 8), ("éééé", 6, 14), ("éééé", 12, 20)]


def test_context_text(spark):
    df = spark.createDataFrame([(2, "b", 0.5, "y"), (1, "a", 0.75, "x")], "rank int, id string, score double, content string")
    assert rag.format_for_llm(df).first()[0] == "[Source 1] (Relevance: 0.75)\nx\n\n---\n\n[Source 2] (Relevance: 0.50)\ny"
    assert rag.text_only(df).first()[0] == "x\n\ny"


def test_statements():
    found = statements.parse("vector search docs field v for [1, x, 2.5] metric L2 where a = 'b AND c' AND n >= 3 limit 4")
    assert (found.query, found.metric, found.limit) == ((1.0, 2.5), "l2", 4)
    assert found.conditions == (Condition("a", "=", "b AND c"), Condition("n", ">=", 3))
    assert statements.parse("FULLTEXT SEARCH d FIELD t FOR 'it''s'").query == "it's"
    assert statements.parse("CREATE FULLTEXT INDEX ON d (t)") == statements.Index("CREATE", True, "d", "t")
    assert statements.parse("get all users") == "SELECT * FROM users"
    assert statements.parse("show me the users") == "SELECT * FROM users LIMIT 10"
    with pytest.raises(ValueError):
        statements.parse("VECTOR SEARCH broken")


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_statements_never_break_sql(sql):
    if not sql.strip().lower().startswith(("vector", "fulltext", "get all", "find all", "show me", "delete")):
        assert statements.parse(sql) == sql


def test_facade(spark):
    db = Database(spark)
    alice, bob = db.insert_batch("user", [{"name": "Alice", "age": 30, "bio": "Rust and graphs"}, {"name": "Bob", "age": 25, "bio": "Gardens"}])
    assert [r["name"] for r in db.query("SELECT name FROM user WHERE age > 28 OR name = 'x'").collect()] == ["Alice"]
    db.create_edge(alice, bob, "follows")
    assert db.shortest_path(alice, bob) == [alice, bob]
    assert db.create_fulltext_index("user", "bio") == 2 and db.create_fulltext_index("user", "bio") == 0
    assert [r["name"] for r in db.fulltext_search("user", "bio", "rust").collect()] == ["Alice"]
    assert db.create_index("user", "age") == 2 and db.index_lookup("user", "age", 30).count() == 1 and db.index_lookup("user", "name", "x") is None
    db.query("UPDATE user SET age = 31 WHERE name = 'Alice'")
    assert db.get(alice)["age"] == 31
    assert db.query("DELETE FROM user WHERE name = 'Bob'").first()[0] == 1
    assert db.edges.count() == 0 and db.status().first()["node_count"] == 1


def test_schema():
    made = schema.fields("name:string:required, kind:enum(a, b), tags:array<int>, owner:ref:user:indexed, email:text:unique")
    assert [f.type.sql() for f in made] == ["TEXT", "TEXT", "JSONB", "UUID", "TEXT"]
    assert [f.nullable for f in made] == [False, True, True, True, True]
    old, new = schema.Schema("t", schema.fields("a:int, b:int")), schema.Schema("u", schema.fields("a:float, c:string:required"))
    assert schema.migration(old, new) == ["ALTER TABLE t RENAME TO u", "ALTER TABLE u ALTER COLUMN a TYPE DOUBLE PRECISION", "ALTER TABLE u ADD COLUMN c TEXT NOT NULL", "ALTER TABLE u DROP COLUMN b"]


def test_schema_problems(spark):
    made = schema.Schema("t", schema.fields("name:string:required, kind:enum(a,b)"))
    df = spark.createDataFrame([("x", "a"), (None, "a"), ("y", "z")], "name string, kind string")
    assert sorted(r["problem"] for r in made.problems(df).collect()) == ["kind outside its values", "missing name"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=20), max_size=50), st.lists(st.text(max_size=20), max_size=20))
def test_bloom(items, others):
    made = Bloom(100).add(items)
    assert all(x in made for x in items)
    both = made.merge(Bloom(100).add(others))
    assert all(x in Bloom.from_bytes(both.to_bytes(), 100) for x in items + others)
    counting = CountingBloom(100).add(["once"])
    assert counting.remove("once") and "once" not in counting


def test_bloom_of_a_table(spark):
    made = build(spark.range(100), "id", 100)
    assert all(str(i) in made for i in range(100))


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456), (None, None)], "s string, x double")
    assert sinks.show_table(df).splitlines()[2] == "a    | 1.2346"
    assert {r["value"] for r in sinks.json_rows(df).collect()} == {'{"s":"a","x":1.23456}', '{"s":null,"x":null}'}
    assert [len(b) for b in ResultStream(spark.range(5)).batches(2)] == [2, 2, 1]
    nodes = spark.createDataFrame([("r", "root"), ("k", "kid"), ("o", "other")], "id string, label string")
    edges = spark.createDataFrame([("r", "k", "e")], "src string, dst string, edge_type string")
    assert sinks.tree(nodes, edges) == "other\nroot\n  kid"
    spark.range(3).selectExpr("cast(id as string) id").write.parquet(str(tmp_path / "in"))
    append(node_stream(spark, str(tmp_path / "in"), "id string"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_inserts_updates_and_limits(spark):
    db = Database(spark)
    assert db.query("INSERT INTO product (name, price) VALUES ('Widget, or so', 9.5), ('B', 4)").first()[0] == 2
    assert db.query("INSERT INTO product VALUES (1, 'x')").first()[0] == 1
    got = {(r["name"], r["col1"]) for r in db.types["product"].collect()}
    assert got == {("Widget, or so", None), ("B", None), (None, "x")}
    assert db.query("SELECT * FROM product", limit=2).count() == 2
    db.query("UPDATE product SET name = concat('me where, ', name), price = price * 2 WHERE name = 'B'")
    assert db.query("SELECT price FROM product WHERE name = 'me where, B'").first()[0] == 8
    assert db.query("DELETE FROM product WHERE name IS NULL OR price > 9").first()[0] == 2
    with pytest.raises(ValueError):
        db.query("INSERT INTO product (a, b) VALUES (1)")
    with pytest.raises(ValueError):
        db.query("UPDATE product SET nonsense")


def test_edges_with_properties_and_errors(spark, tmp_path):
    db = Database(spark, "people")
    a, b = db.insert_batch("person", [{"name": "A"}, {"name": "B"}])
    e = db.create_edge(a, b, "follows", {"since": "2024"})
    db.create_edges_batch([(b, a, "knows"), (b, a, "knows", {"weight": 2})])
    assert db.get_edge(e)["since"] == "2024" and db.get_edge("none") is None
    assert sorted((r["edge_type"], r["weight"] or 0) for r in db.get_edges_from(b).collect()) == [("knows", 0), ("knows", 2)]
    with pytest.raises(ValueError):
        db.get("not-a-valid-uuid")
    with pytest.raises(KeyError):
        db.update("00000000-0000-0000-0000-000000000000", {"name": "x"})
    assert db.get("00000000-0000-0000-0000-000000000000") is None and db.delete("00000000-0000-0000-0000-000000000000") is False
    with pytest.raises(ValueError):
        db.insert("person", "not valid json")
    db.insert("person", '{"name": "C"}')
    db.schema.create("person", "name:string:required, kind:enum(a, b)")
    db.create_fulltext_index("person", "name")
    db.save(str(tmp_path / "db"))
    again = Database.open(spark, str(tmp_path / "db"))
    assert again.name == "people" and again.get(a)["name"] == "A" and again.edges.count() == 3
    assert again.schema.schemas == db.schema.schemas and again.list_fulltext_indexes() == [("person", "name")]


def test_many_changes_keep_plans_short(spark):
    db = Database(spark)
    node = db.insert("thing", {"n": 0})
    for i in range(1, 90):
        db._changed("thing", db.types["thing"].withColumn("n", F.lit(i)))
    assert db.get(node)["n"] == 89
    assert db.types["thing"]._jdf.queryExecution().logical().toString().count("Project") < 45


def test_statement_conditions_that_are_no_list():
    found = statements.parse("VECTOR SEARCH d FIELD v FOR [1] WHERE a = 1 OR b = 'LIMIT 3' LIMIT 2")
    assert found.conditions == () and found.expression == "a = 1 OR b = 'LIMIT 3'" and found.limit == 2
    assert statements.parse("delete ") == "delete "
    with pytest.raises(ValueError):
        statements.parse("VECTOR SEARCH d FIELD v FOR [1] nonsense")
    with pytest.raises(ValueError):
        statements.conditions("a = 1 OR b = 2")


def test_lookups_reach_the_scan(spark, sf_dir):
    from veldspar.operators import relational
    from veldspar.sources.tables import edges, nodes

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan(relational.get(nodes(spark, sf_dir, "orders"), "orders:7"))
    assert "EqualTo(o_custkey,1)" in plan(edges(spark, sf_dir, src=["customer:1"])) and "nation.parquet" not in plan(edges(spark, sf_dir, src=["customer:1"], types=["placed"]))
    assert "In(c_custkey" in plan(relational.multi_get(spark, nodes(spark, sf_dir, "customer"), ["customer:1", "customer:2"])) or "EqualTo(c_custkey" in plan(relational.multi_get(spark, nodes(spark, sf_dir, "customer"), ["customer:1", "customer:2"]))
    assert relational.get(nodes(spark, sf_dir, "orders"), "orders:7x").count() == 0


def test_stored_text_index(spark, sf_dir):
    from veldspar.operators import fulltext
    from veldspar.sources.tables import nodes

    docs = nodes(spark, sf_dir, "documents").select("id", "type", "text")
    index = fulltext.StoredIndex(docs, "text")
    word = index.postings.groupBy("token").count().orderBy(F.desc("count"), "token").first()["token"]
    assert [tuple(r) for r in index.search(f"the {word} {word}", 5).collect()] == [tuple(r) for r in fulltext.search(docs, "text", f"the {word} {word}", 5).collect()]
    plan = index.of([word])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("(bucket#", "bucket").replace("[isnotnull", "[bucket") and f"EqualTo(token,{word})" in plan
    assert index.search("the").count() == 0 and index.documents() == fulltext.indexed_documents(docs, "text")


def test_readers_and_envelopes(spark, tmp_path):
    import json

    from veldspar.functions import keys
    from veldspar.sources import tables

    (tmp_path / "a.csv").write_text("x,y\n1,\"b, c\"\n")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.txt").write_text("two\nlines")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "b, c")]
    assert [r["content"] for r in tables.read_texts(spark, str(tmp_path / "t")).collect()] == ["two\nlines"]
    sinks.write_csv(spark.createDataFrame([(1, 'q"')], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape="\\").first()["a"] == "1"
    got = json.loads(sinks.envelope(spark.createDataFrame([(1, None)], "a int, b string")))
    assert (got["columns"], got["rows"], got["rows_affected"]) == (["a", "b"], [[1, None]], 0) and got["execution_time_ms"] >= 0
    ranked = spark.createDataFrame([(1, "x", 0.5, 3, "d")], "rank int, content string, score double, estimated_tokens long, doc string")
    assert json.loads(rag.to_json(ranked, "q", "doc").first()[0]) == {"query": "q", "total_tokens": 3, "chunks": [{"content": "x", "score": 0.5, "document_id": "d"}]}
    points = keys.ring(4, 20)
    spread = {r[0]: r[1] for r in spark.range(400).groupBy(keys.ring_shard(F.col("id").cast("string"), points).alias("s")).count().collect()}
    fewer = spark.range(400).select("id", keys.ring_shard(F.col("id").cast("string"), points).alias("a"), keys.ring_shard(F.col("id").cast("string"), [p for p in points if p[1] != 3]).alias("b"))
    assert set(spread) == {0, 1, 2, 3} and fewer.where("a <> 3 AND a <> b").count() == 0  # a shard that goes moves only its own keys
