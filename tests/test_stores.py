"""Stored indexes, files, histories, targeting, queues on streams, and what scans are asked to filter."""

import pytest
from graphscan import suite
from graphscan.engine import Engine
from graphscan.functions import scalars
from graphscan.operators import history
from graphscan.operators.predicates import edge_props
from graphscan.sources import catalog, files
from graphscan.sources.graph import GraphSource
from graphscan.streaming import queues
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_point_lookups_reach_the_scan(spark):
    explain = suite.engine(spark, SF).explain
    assert "In(c_custkey, [7])" in explain('SELECT A.id AS a FROM root{id:["customer:7"]} AS A').replace("EqualTo(c_custkey,7)", "In(c_custkey, [7])")
    assert "EqualTo(r_name,ASIA)" in explain('SELECT A.id AS a FROM root{type:"region",name:"ASIA"} AS A')
    plan = suite.queries()["join_left"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderstatus#") > 0 and plan.count("Relation [") <= 3


def test_index_store(spark, tmp_path):
    store = catalog.IndexStore(spark, f"file://{tmp_path}/indexes")
    schema = "id string, v int, key string"
    assert store.tables() == []
    store.ensure("nodes", schema)
    store.ensure("nodes", schema)
    assert store.read("nodes").count() == 0 and store.stats().count() == 0
    rows = spark.createDataFrame([("a", 1, "k/1"), ("b", 2, "k/1"), ("c", 3, "k/2"), ("d", 4, "k/3")], schema)
    store.append("nodes", rows)
    store.ensure("edges", schema)
    store.upsert("nodes", spark.createDataFrame([("a", 9, "k/1"), ("e", 5, "k/2"), ("e", 5, "k/2")], schema))
    assert sorted(map(tuple, store.read("nodes").select("id", "v").collect())) == [("a", 9), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]
    store.delete_key("k/2")
    store.delete_where("nodes", F.col("v") == 4)
    store.delete_where("nodes", F.col("id") == "b")
    assert [tuple(r) for r in store.read("nodes").select("id", "v", "key").collect()] == [("a", 9, "k/1")]
    assert store.tables() == ["edges", "nodes"] and {(r.table, r.key, r.n_rows) for r in store.stats().collect()} == {("nodes", "k/1", 1)}
    store.cycle("nodes", schema)
    assert store.read("nodes").count() == 0
    store.drop("nodes")
    assert store.tables() == ["edges"]


def test_metadata(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert sorted(map(tuple, catalog.upserted(rows, new, ["k"], "n").collect())) == [(1, "a", 0), (2, "y", 2), (3, "z", 1)]
    assert sorted(map(tuple, catalog.updated(rows, spark.createDataFrame([(1, None)], "k int, v string"), ["k"]).collect()), key=str) == [(1, None, 0), (2, "b", 0)]
    assert [r.k for r in catalog.deleted(rows, new, ["k"]).collect()] == [1] and [r.k for r in catalog.looked_up(rows, new, ["k"]).collect()] == [2]


def test_files_and_trees(spark, tmp_path):
    for name in ("a/b/x.ts", "a/y.rb", "z.js", "readme.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    found = files.read_files(spark, f"file://{tmp_path}")
    assert sorted((r.path, r.text) for r in found.collect()) == sorted((n, f"text of {n}") for n in ("a/b/x.ts", "a/y.rb", "z.js", "readme.md"))
    assert sorted((r.path, r.language) for r in files.by_language(found).collect()) == [("a/b/x.ts", "javascript"), ("a/y.rb", "ruby"), ("z.js", "javascript")]
    shown = [(r.parent, r.name, r.is_dir, r.n) for r in files.in_listing_order(files.listing(found)).collect()]
    assert shown == [("", "a", True, 2), ("", "readme.md", False, 1), ("", "z.js", False, 1), ("a", "b", True, 1), ("a", "y.rb", False, 1), ("a/b", "x.ts", False, 1)]
    tree = lambda rows: spark.createDataFrame(rows, "path string, blob string")
    changes = files.tree_diff(tree([("a", "1"), ("b", "1"), ("c", "1")]), tree([("b", "2"), ("c", "1"), ("d", "1")]))
    assert sorted(map(tuple, changes.collect())) == [("a", "delete"), ("b", "modify"), ("d", "add")]
    dirty = spark.createDataFrame([("a", "modify"), ("e", "delete")], "path string, change string")
    plan = lambda *x: sorted(map(tuple, files.snapshot_plan(*x).collect()))
    whole = tree([("p", "1"), ("q", "1")])
    assert plan(None, None, whole) == [("p", "copy"), ("q", "copy")] and plan(changes, None, whole) == [("a", "delete"), ("b", "copy"), ("d", "copy")]
    assert plan(changes, dirty, whole) == [("a", "copy"), ("b", "copy"), ("d", "copy"), ("e", "delete")] and plan(None, dirty, whole) == [("a", "copy"), ("e", "delete"), ("p", "copy"), ("q", "copy")]


def test_index_plans(spark):
    commits = spark.createDataFrame([("c", ["b", "x"]), ("b", ["a"]), ("a", []), ("x", ["a"]), ("d", ["c"]), ("lone", [])], "sha string, parents array<string>")
    shas = lambda *s: spark.createDataFrame([(x,) for x in s], "sha string")
    got = {r.head: (r.action, r.base, r.depth) for r in history.index_plan(commits, shas("d", "a", "b", "lone"), shas("b")).collect()}
    assert got == {"d": ("overlay", "b", 2), "a": ("overlay", "b", 1), "b": ("skip", "b", 0), "lone": ("root", None, None)}
    dirty = history.dirty_reuse(spark.createDataFrame([(1, "a", "s")], "repo int, sha string, signature string"), spark.createDataFrame([(1, "a", "s", 1, 7), (1, "a", "s", 2, 8), (1, "a", "t", 3, 9)], "repo int, sha string, signature string, created int, index_id int"))
    assert [r.index_id for r in dirty.collect()] == [8]


def test_targeting(spark):
    nodes = spark.createDataFrame([("a", "t", "n", 0, ["n"], [], "k1", "p", 1), ("b", "t", "n", 0, ["n"], [], "k2", "q", 2)], "id string, type string, name string, index int, search_name array<string>, props array<struct<key:string,value:string>>, key string, path string, org_id int")
    edges = spark.createDataFrame([("e", "a", "b", "n", 0, "k1", 1)], "type string, from string, to string, name string, index int, key string, org_id int")
    engine = Engine(GraphSource({None: nodes}, {None: edges}))
    ids = lambda e: sorted(r.root for r in e.graph("root{all}").collect())
    assert ids(engine) == ["a", "b"] and ids(engine.on_keys(["k2"])) == ["b"] and ids(engine.on_org(1)) == ["a"]
    assert engine.on_keys(["k2"]).graph('root{all}.linear_traverse[t["e"]]').count() == 0
    props = spark.createDataFrame([(1, [("a", "1")]), (2, [("b", "2"), ("c", "3")]), (3, [])], "i int, props array<struct<key:string,value:string>>")
    assert sorted(r.i for r in props.where(edge_props([("a", "1"), ("c", "3")])).collect()) == [1, 2]


def test_texts(spark):
    rows = spark.createDataFrame([("src/a/b.ts", "../c/d.ts"), ("src/a/b.ts", "./e"), ("b.ts", "./x/index.js"), ("src/b.ts", "lodash/fp")], "here string, module string")
    assert [r[0] for r in rows.select(scalars.import_target(F.col("here"), F.col("module"))).collect()] == ["src/c/d", "src/a/e", "x", "lodash/fp"]
    with pytest.raises(Exception, match="nothing at"):
        rows.select(scalars.at_path(F.lit('{"a": 1}'), "$.b", True)).collect()
    assert rows.select(scalars.row_id(F.lit(None), F.lit("x")) != scalars.row_id(F.lit(""), F.lit("x"))).first()[0]


def test_queues_on_streams(spark, tmp_path):
    schema = "op string, id string, bucket string, priority int"
    rounds = [[("put", "a", "x", 1), ("put", "b", "x", 5), ("put", "c", "y", 1)], [("put", "d", "y", 9)], [("done", "b", "x", 5)]]
    want = [{"b", "c"}, set(), {"a"}]
    for number, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        queues.bucket_queue(stream, f"{tmp_path}/working", f"{tmp_path}/out", f"{tmp_path}/check", "bucket", "priority", "id").awaitTermination()
        batch = spark.read.schema("id string").parquet(f"{tmp_path}/out/batch={number}")
        assert {r.id for r in batch.collect()} == want[number]
    spark.createDataFrame([("1", "4"), ("2", "x"), ("3", None)], "id string, payload string").write.parquet(f"{tmp_path}/items")
    items = spark.readStream.schema("id string, payload string").parquet(f"{tmp_path}/items")
    queues.run_items(items, lambda p: str(2 * int(p)), f"{tmp_path}/done", f"{tmp_path}/check2").awaitTermination()
    got = {r.id: (r.result, r.error and r.error.split(":")[0]) for r in spark.read.parquet(f"{tmp_path}/done").collect()}
    assert got == {"1": ("8", None), "2": (None, "ValueError"), "3": (None, "TypeError")}
