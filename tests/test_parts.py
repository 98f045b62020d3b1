"""Linking, merge joins, overlays, text helpers, queues and live indexes."""

import os

import pytest
from graphscan.functions import scalars
from graphscan.operators import linker
from graphscan.sources.graph import overlay
from graphscan.streaming import queues
from pyspark.sql import functions as F


@pytest.mark.parametrize(("left", "right", "flags", "rows"), [
    ([1, 2, 3], [1, 2, 3], (False, False), 3), ([1] * 5, [1], (False, False), 5), ([1, 2, 3, 4, 5], [3], (True, False), 5), ([3, 5, 8], [4, 7, 9], (True, False), 3), ([3], [1, 2, 3, 4, 5], (False, True), 5),
    ([], [1, 2], (True, True), 2),
])
def test_keyed_join(spark, left, right, flags, rows):
    a, b = (spark.createDataFrame([(x, n) for n, x in enumerate(v)], f"key int, {c} int") for v, c in ((left, "l"), (right, "r")))
    assert linker.keyed_join(a, b, "key", *flags).count() == rows


def test_link_and_bad_edges(spark):
    lookups = spark.createDataFrame([("call1", "a.ts", 5), ("call2", "a.ts", 9)], "node_id string, path string, index int")
    definitions = spark.createDataFrame([("a.ts", 5, "b.ts", 10, 20)], "path string, index int, def_path string, start_index int, end_index int")
    symbols = spark.createDataFrame([("b.ts", 10, 20, "fn"), ("b.ts", 10, 21, "other")], "path string, start_index int, end_index int, node_id string")
    edges = linker.link(lookups, definitions, symbols)
    assert [(r["from"], r.to, r.type) for r in edges.collect()] == [("call1", "fn", "call-link")]
    assert linker.without_bad_edges(edges.unionByName(edges.withColumn("to", F.lit("")))).count() == 1


def test_link_spreads_by_rows(spark, monkeypatch):
    lookups = spark.createDataFrame([(f"call{i}", f"{i % 7}.ts", 5) for i in range(60)] * 2 + [("none", None, 5)], "node_id string, path string, index int")
    definitions = spark.createDataFrame([(f"{i}.ts", 5, "b.ts", at, 20) for i in range(7) for at in (10, 11)] * 2, "path string, index int, def_path string, start_index int, end_index int")
    symbols = spark.createDataFrame([("b.ts", 10, 20, "fn"), ("b.ts", 11, 20, "fn")], "path string, start_index int, end_index int, node_id string")
    monkeypatch.setattr(linker, "PART_ROWS", 10, raising=False)
    edges = linker.link(lookups, definitions, symbols)
    assert sorted((r["from"], r.to) for r in edges.collect()) == sorted((f"call{i}", "fn") for i in range(60))
    # 121 lookups and 28 definitions: neither the join nor its distinct rows are left to as many partitions as a small table gets
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == plan.count(", 15") == 3


def test_overlay(spark):
    rows = spark.createDataFrame([("root", "a", 1), ("root", "b", 2), ("diff", "a", 3)], "key string, path string, n int")
    changed = spark.createDataFrame([("a",), ("gone",)], "path string")
    assert sorted(r.n for r in overlay(rows, "root", "diff", changed).collect()) == [2, 3]


def test_text_helpers(spark):
    df = spark.createDataFrame([("l1\nl2\nl3\nl4\nl5\nl6\nl7", "git@github.com:me/repo.git")], "t string, u string")
    r = df.select(
        scalars.nearby(F.col("t"), F.lit(4), F.lit(4)).alias("near"), scalars.extracted(F.col("t"), F.lit(3), F.lit(5)).alias("x"), scalars.remote_owner(F.col("u")).alias("o"), scalars.remote_name(F.col("u")).alias("n"),
        scalars.cat(F.lit("a"), F.lit(None)).alias("c"), scalars.path_cat(F.lit('"a"'), F.lit(None), F.lit("b")).alias("p"),
    ).first()
    assert (r.near, r.x, r.o, r.n, r.c, r.p) == ("l2\nl3\nl4\nl5\nl6", "l2", "me", "repo", "a", "a//b")


def test_append_index_is_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("n1", "k1"), ("n2", "k2")], "id string, key string").write.parquet(source)
    stream = spark.readStream.schema("id string, key string").parquet(source)
    for checkpoint in ("c1", "c2"):  # the second run replays the first batch
        queues.append_index(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("batch")) == ["batch=0"]


def test_idempotent_queue(spark, tmp_path):
    source = str(tmp_path / "q")
    rows = [("a", "put", "1"), ("a", "put", "2"), ("b", "put", "3")]
    spark.createDataFrame(rows, "key string, op string, payload string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key string, op string, payload string").parquet(source)
    query = queues.idempotent_queue(stream).writeStream.format("memory").queryName("emitted").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("emitted").collect())) == [("a", "1"), ("b", "3")]
