"""Registered queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import scalars
from .ingest import index
from .lang.tree import EdgeType, Follow, Linear
from .operators import history, linker
from .operators.traverse import walk
from .plans.registry import tabular_registry
from .sources import catalog, files
from .sources.graph import PROPS, GraphSource, latest_per, overlay, stale_versions
from .sources.shared import shared_folder
from .sources.tabular import tabular_graph
from .streaming import queues

FLAGSHIP = "path_two_grouped"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(tabular_graph(spark, sf_dir), tabular_registry())


# name: (language, text, SQL); columns "A.id" and so on are named by their aliases
_TEXTS: dict[str, tuple[str, str, str]] = {
    "scan_type": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"nation"} AS A', "SELECT 'nation:' || n_nationkey AS a, n_name AS n FROM nation"),
    "scan_types": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:["nation","region"]} AS A', "SELECT 'nation:' || n_nationkey AS a, n_name AS n FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region"),
    "scan_name_exact": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"region",name:"ASIA"} AS A', "SELECT 'region:' || r_regionkey AS a, r_name AS n FROM region WHERE r_name = 'ASIA'"),
    "scan_name_in": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"order",name:["O","P"]} AS A', "SELECT 'order:' || o_orderkey AS a, o_orderstatus AS n FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    "scan_name_wildcard": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"customer",name:"*1?0"} AS A', "SELECT 'customer:' || c_custkey AS a, c_name AS n FROM customer WHERE c_name LIKE '%1_0'"),
    "scan_name_regex": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"customer",name:"/Customer#0*[1-3]5/"} AS A', "SELECT 'customer:' || c_custkey AS a, c_name AS n FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-3]5')"),
    "scan_name_or": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"event",name:["click","pur*","/v.+w/"]} AS A', "SELECT 'event:' || event_id AS a, event_type AS n FROM events WHERE event_type = 'click' OR event_type LIKE 'pur%' OR regexp_full_match(event_type, 'v.+w')"),
    "scan_index": ("r", 'SELECT A.id AS a, A.name AS n FROM root{type:"part",index:[1,7]} AS A', "SELECT 'part:' || p_partkey AS a, p_name AS n FROM part WHERE p_size IN (1, 7)"),
    "scan_id": ("r", 'SELECT A.id AS a, A.name AS n FROM root{id:["customer:7","nation:3"]} AS A', "SELECT 'customer:' || c_custkey AS a, c_name AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation WHERE n_nationkey = 3"),
    "scan_props": ("r", 'SELECT A.id AS a FROM root{type:"customer",props:{"segment":"BUILDING","segment":"MACHINERY"}} AS A', "SELECT 'customer:' || c_custkey AS a FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "scan_not_type": ("r", 'SELECT A.id AS a FROM root{not_type:["event","turn","document","order","part","customer"]} AS A', "SELECT 'nation:' || n_nationkey AS a FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier"),
    "scan_all": ("r", "SELECT COUNT(A) AS n FROM root{all} AS A", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM documents) AS n"),
    "file_filter": ("r", 'SELECT A.id AS a FROM %targeting(file="1*.txt") root{type:"document"} AS A', "SELECT 'document:' || doc_id AS a FROM documents WHERE doc_id::VARCHAR LIKE '1%'"),
    "hop_forward": ("r", 'SELECT A.id AS a, B.id AS b, B.name AS n FROM root{type:"customer"} AS A TRACE join[A].linear_traverse[t["placed"]] AS B', "SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b, o_orderstatus AS n FROM orders"),
    "hop_reverse": ("r", 'SELECT A.id AS a, B.name AS n FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["placed".reverse]] AS B', "SELECT 'order:' || o_orderkey AS a, c_name AS n FROM orders JOIN customer ON c_custkey = o_custkey"),
    "hop_multi_type": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["contains","shipped_by"]] AS B', "SELECT a, b FROM (SELECT DISTINCT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b, l_returnflag, l_linenumber FROM lineitem) UNION ALL SELECT a, b FROM (SELECT DISTINCT 'order:' || l_orderkey AS a, 'supplier:' || l_suppkey AS b, l_linestatus, l_linenumber FROM lineitem)"),
    "hop_edge_name": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t[{type:"contains",name:"R"}]] AS B', "SELECT a, b FROM (SELECT DISTINCT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b, l_linenumber FROM lineitem WHERE l_returnflag = 'R')"),
    "hop_edge_index": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t[{type:"contains",index:[1,2]}]] AS B', "SELECT a, b FROM (SELECT DISTINCT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b, l_returnflag, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 2))"),
    "path_two": ("r", 'SELECT A.id AS a, B.name AS n FROM root{type:"customer"} AS A TRACE join[A].linear_traverse[t["cust_nation"],t["in_region"]] AS B', "SELECT 'customer:' || c_custkey AS a, r_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "path_two_grouped": ("r", 'SELECT C.name AS nation, COUNT(A) AS orders FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["placed".reverse],t["cust_nation"]] AS C', "SELECT n_name AS nation, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "path_optional": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"customer"} AS A TRACE join[A].linear_traverse[?["cust_nation"],?["in_region"]] AS B', "WITH j AS (SELECT 'customer:' || c_custkey AS a, 'nation:' || n_nationkey AS n, 'region:' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT a, a AS b FROM j UNION ALL SELECT a, n FROM j UNION ALL SELECT a, r FROM j"),
    "path_star": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"turn",index:0} AS A TRACE join[A].linear_traverse[*["next_turn"]] AS B', "WITH RECURSIVE w AS (SELECT conv_id, turn, turn AS e FROM conversations WHERE turn = 0 UNION ALL SELECT w.conv_id, w.turn, c.turn FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.e + 1) SELECT 'turn:' || conv_id || ':' || turn AS a, 'turn:' || conv_id || ':' || e AS b FROM w"),
    "path_star_then_hop": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"turn",index:0} AS A TRACE join[A].linear_traverse[*["next_turn"],t["next_turn"]] AS B', "WITH RECURSIVE w AS (SELECT conv_id, turn, turn AS e FROM conversations WHERE turn = 0 UNION ALL SELECT w.conv_id, w.turn, c.turn FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.e + 1) SELECT 'turn:' || conv_id || ':' || turn AS a, 'turn:' || conv_id || ':' || e AS b FROM w WHERE e > turn"),
    "repeat_plus": ("r", 'SELECT A.id AS a, B.name AS n, COUNT(B) AS c FROM root{type:"turn",index:0} AS A TRACE join[A].repeated_traverse{follow:[],repeat:[t["next_turn"]]} AS B', "SELECT 'turn:' || conv_id || ':0' AS a, role AS n, count(*) AS c FROM conversations WHERE turn > 0 GROUP BY 1, 2"),
    "cycle_guard": ("r", 'SELECT A.id AS a, B.id AS b FROM root{id:["customer:1","customer:2"]} AS A TRACE join[A].linear_traverse[*["placed","placed".reverse]] AS B', "SELECT 'customer:' || c_custkey AS a, 'customer:' || c_custkey AS b FROM customer WHERE c_custkey IN (1, 2) UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders WHERE o_custkey IN (1, 2)"),
    "node_check": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"customer"} AS A TRACE join[A].linear_traverse[t["placed"]].node_check{type:"order",name:"F"} AS B', "SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders WHERE o_orderstatus = 'F'"),
    "join_left": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"order"} AS A TRACE left_join[A].linear_traverse[t[{type:"contains",name:"R"}]] AS B', "SELECT 'order:' || o_orderkey AS a, b FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, 'part:' || l_partkey AS b, l_linenumber FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey"),
    "join_fork": ("r", 'SELECT A.id AS a, B.name AS b, C.name AS c FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["placed".reverse]] AS B TRACE join[A].linear_traverse[t["shipped_by"]] AS C', "SELECT 'order:' || o_orderkey AS a, c_name AS b, s_name AS c FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_linestatus, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"),
    "join_fork_left": ("r", 'SELECT A.id AS a, B.id AS b, C.id AS c FROM root{type:"nation"} AS A TRACE join[A].linear_traverse[t["in_region"]] AS B TRACE left_join[A].linear_traverse[t["supp_nation".reverse]] AS C', "SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b, 'supplier:' || s_suppkey AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "join_chain": ("r", 'SELECT A.name AS a, B.name AS b, C.name AS c FROM root{type:"supplier"} AS A TRACE join[A].linear_traverse[t["supp_nation"]] AS B TRACE join[B].linear_traverse[t["in_region"]] AS C', "SELECT s_name AS a, n_name AS b, r_name AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "anti": ("r", 'SELECT A.id AS a FROM root{type:"order"} AS A TRACE left_join[A].linear_traverse[t["contains"]] AS B HAVING B IS_NULL', "SELECT 'order:' || o_orderkey AS a FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "having_not_null": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"nation"} AS A TRACE left_join[A].linear_traverse[t["supp_nation".reverse]] AS B HAVING B IS_NOT_NULL', "SELECT 'nation:' || s_nationkey AS a, 'supplier:' || s_suppkey AS b FROM supplier"),
    "having_or": ("r", 'SELECT A.id AS a, B.id AS b, C.id AS c FROM root{type:"order"} AS A TRACE left_join[A].linear_traverse[t[{type:"contains",index:7}]] AS B TRACE left_join[A].linear_traverse[t[{type:"shipped_by",name:"F",index:1}]] AS C HAVING_OR B IS_NOT_NULL HAVING_OR C IS_NOT_NULL', "SELECT 'order:' || o_orderkey AS a, b, c FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k, 'part:' || l_partkey AS b, l_returnflag FROM lineitem WHERE l_linenumber = 7) AS x ON x.k = o_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k, 'supplier:' || l_suppkey AS c FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'F') AS y ON y.k = o_orderkey WHERE b IS NOT NULL OR c IS NOT NULL"),
    "intersect": ("r", 'SELECT A.id AS a, B.id AS b FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["placed".reverse],t["cust_nation"]] AS B TRACE join[A].linear_traverse[t["shipped_by"],t["supp_nation"]] AS C INTERSECT B, C', "SELECT 'order:' || o_orderkey AS a, 'nation:' || c_nationkey AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_linestatus, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey"),
    "cat": ("r", 'SELECT CAT(A.name, B.name) AS c, PATHCAT(A.id, B.name) AS p FROM root{type:"nation"} AS A TRACE left_join[A].linear_traverse[t["supp_nation".reverse]] AS B', "SELECT n_name || coalesce(s_name, '') AS c, 'nation:' || n_nationkey || '/' || coalesce(s_name, '') AS p FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "count_all": ("r", 'SELECT COUNT(A, B) AS n FROM root{type:"nation"} AS A TRACE join[A].linear_traverse[t["in_region"]] AS B', "SELECT 2 * count(*) AS n FROM nation"),
    "count_group": ("r", 'SELECT B.name AS n, COUNT(A) AS c FROM root{type:"part"} AS A TRACE join[A].linear_traverse[t["contains".reverse]] AS B', "SELECT o_orderstatus AS n, count(*) AS c FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"),
    "distinct_order": ("r", 'SELECT B.name AS n, A.name AS m FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["placed".reverse],t["cust_nation"]] AS B ORDER BY n DESC, m', "SELECT DISTINCT n_name AS n, o_orderstatus AS m FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"),
    "order_grouped_top": ("r", 'SELECT B.name AS n, COUNT(A) AS c FROM root{type:"order"} AS A TRACE join[A].linear_traverse[t["placed".reverse]] AS B ORDER BY c DESC, n LIMIT 20', "SELECT c_name AS n, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY c DESC, n LIMIT 20"),
    "limit_offset": ("r", 'SELECT A.id AS a FROM root{type:"part"} AS A OFFSET 10 LIMIT 25', "SELECT 'part:' || p_partkey AS a FROM part ORDER BY 1 LIMIT 25 OFFSET 10"),
    "scroll": ("r", '%scroll(A:["tables","customer","customer:5"]) SELECT A.id AS a FROM root{type:"customer"} AS A LIMIT 50', "SELECT 'customer:' || c_custkey AS a FROM customer WHERE 'customer:' || c_custkey >= 'customer:5' ORDER BY 1 LIMIT 50"),
    "logic_simple": ("l", "tables::customer(C). tables::placed(C, O)[name=\"F\"]. %SELECT(C.name AS c, O.id AS o).", "SELECT c_name AS c, 'order:' || o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"),
    "logic_cost_root": ("l", 'tables::region(R)[name="ASIA"]. tables::in_region(N, R). tables::cust_nation(C, N). tables::placed(C, O). %SELECT(N.name AS n, COUNT(O) AS orders).', "SELECT n_name AS n, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "logic_cycle": ("l", "tables::placed(C, O). tables::cust_nation(C, N). tables::shipped_by(O, S). tables::supp_nation(S, N). %SELECT(O.id AS o, N.name AS n).", "SELECT 'order:' || o_orderkey AS o, n_name AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_linestatus, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey"),
    "logic_optional": ("l", 'tables::order(O). tables::contains(O, P)[name="R"]?. %SELECT(O.id AS o, P.id AS p).', "SELECT 'order:' || o_orderkey AS o, p FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, 'part:' || l_partkey AS p, l_linenumber FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey"),
    "logic_repeated": ("l", "tables::turn(T)[index=1]. tables::later_turn(T, U). %root(T). %SELECT(T.id AS t, U.id AS u).", "SELECT 'turn:' || conv_id || ':0' AS t, 'turn:' || conv_id || ':' || turn AS u FROM conversations WHERE turn > 0"),
}


def collect_group(spark, sf_dir):
    out = engine(spark, sf_dir).relational('SELECT B.name AS n, COLLECT(A.name) AS l FROM root{type:"nation"} AS A TRACE join[A].linear_traverse[t["in_region"]] AS B')
    return out.select("n", F.array_join(F.array_sort("l"), ",").alias("l"))


def graph_trace(spark, sf_dir):
    return engine(spark, sf_dir).graph('root{type:"supplier"}.linear_traverse[t["supp_nation"]].linear_traverse[?["in_region"]]')


def bounded_repeat(spark, sf_dir):
    source = tabular_graph(spark, sf_dir)
    rows = source.nodes(["turn"]).where("index = 0").select("id", F.col("id").alias("at"))
    return walk(rows, source, Linear((Follow("*", (EdgeType("next_turn"),)),)), deepest=2).toDF("a", "b")


def logic_components(spark, sf_dir):
    """Two unconnected parts, each its own plan."""
    e, text = engine(spark, sf_dir), 'tables::nation(N). tables::in_region(N, R). tables::part(P)[name="*steel*"].'
    a, b = e.logic(text, 0).toDF("n", "r"), e.logic(text, 1).select(F.col("P").alias("n"), F.lit(None).cast("string").alias("r"))
    return a.unionByName(b)


def order_json_compat(spark, sf_dir):
    out = engine(spark, sf_dir).relational('SELECT B.name AS n, COUNT(A) AS c FROM root{type:"supplier"} AS A TRACE join[A].linear_traverse[t["supp_nation"]] AS B ORDER BY c DESC', compat=True)
    return out.select("n", "c")


def _pieces(spark, sf_dir):
    """Documents with the position of their second line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    cut = F.instr("text", "\n")
    rows = docs.select("doc_id", F.lit("tables").alias("key"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit(0).alias("start_index"), F.when(cut > 0, cut - 1).otherwise(F.length("text")).alias("end_index"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return engine(spark, sf_dir).hydrate(rows)


def hydrate_extract(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", "extracted")


def hydrate_nearby(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", "nearby", "truncated")


def checksum(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", "checksum")


def overlay_index(spark, sf_dir):
    """Orders of status F as a diff over all orders; customers stand for files."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", F.col("o_custkey").alias("path"), F.lit("root").alias("key")).unionByName(orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("path"), F.lit("diff").alias("key")))
    return overlay(rows, "root", "diff", rows.where("key = 'diff'").select("path")).select("o_orderkey", F.col("path").alias("file"), "key")


def latest_version(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return latest_per(events, "user_id", "ts", "event_id").select("user_id", "event_id")


def stale(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stale_versions(events, ["user_id", "event_type"], "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


def running_progress(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return queues.running_progress(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("event_id", "done", F.round("share", 6).alias("share"))


def dedupe_queue(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return queues.first_per_key(events, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def bucket_queue(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("id", F.col("event_id"))
    return queues.next_per_bucket(events, events.where("event_type = 'click'"), "user_id", "value", "event_id").select("user_id", "event_id")


def link_lookups(spark, sf_dir):
    """Order lines look up the supplier that their part's next line names; shape of the linker join."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lookups = lines.select(F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("index"))
    definitions = lines.select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("index"), F.col("l_suppkey").alias("def_path"), F.lit(0).alias("start_index"), F.lit(1).alias("end_index"))
    symbols = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("path"), F.lit(0).alias("start_index"), F.lit(1).alias("end_index"), F.col("s_nationkey").alias("node_id"))
    return linker.link(lookups, definitions, symbols).select("from", "to")


def commit_chain(spark, sf_dir):
    """Turns of a conversation as a chain of commits."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    commits = turns.select(at(F.col("turn")).alias("sha"), F.when(F.col("turn") > 0, F.array(at(F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    return linker.commit_chain(commits, "0:3", 3)


def schema_violations(spark, sf_dir):
    source = tabular_graph(spark, sf_dir)
    legal = spark.createDataFrame([("customer", "cust_nation", "nation"), ("nation", "in_region", None)], "from_type string, type string, to_type string")
    edges = source.edges("cust_nation").unionByName(source.edges("in_region")).unionByName(source.edges("supp_nation"))
    return linker.schema_violations(source.nodes(["customer", "supplier", "nation", "region"]), edges, legal).select("from", "type", "to")


def left_right_full(spark, sf_dir):
    """Rows per kind of match of a two-sided outer keyed join."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    a, b = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.lit(1).alias("l")), lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("key"), F.lit(1).alias("r"))
    return linker.keyed_join(a, b, "key", True, True).groupBy(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r")).agg(F.count("*").alias("n"))


def scalar_helpers(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = scalars.index_key(F.lit("-1"), F.lit("a/b"), F.col("page_id"), F.lit(7))
    return pages.select("page_id", key.alias("key"), scalars.repo_of_key(key).alias("repo"), scalars.range_text(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("shown"), F.url_encode("url").alias("url"))


def index_stats(spark, sf_dir):
    """Nodes of each type."""
    return tabular_graph(spark, sf_dir).nodes().groupBy("type").agg(F.count("*").alias("n"))


def _orders_by_key(spark, sf_dir) -> Engine:
    """Customers and their orders, the order's status as index key."""
    source = tabular_graph(spark, sf_dir)
    customers = source.nodes(["customer"]).withColumn("key", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P")))).drop("_raw")
    orders = source.nodes(["order"]).withColumn("key", F.col("name")).drop("_raw")
    return Engine(GraphSource({"customer": customers, "order": orders}, {"placed": source.edges("placed").withColumn("key", F.col("name"))}, {"placed": ("customer", "order")}), tabular_registry())


def targeted_graph(spark, sf_dir):
    """A path query over one index of several."""
    return _orders_by_key(spark, sf_dir).on_keys(["F"]).graph('root{type:"customer"}.linear_traverse[t["placed"]]').select("root", "terminus")


def targeted_relational(spark, sf_dir):
    return _orders_by_key(spark, sf_dir).on_keys(["O", "P"]).relational('SELECT A.id AS a, A.name AS n FROM root{type:"order"} AS A')


def targeted_logic(spark, sf_dir):
    return _orders_by_key(spark, sf_dir).on_keys(["P"]).logic('tables::customer(C). tables::placed(C, O). %SELECT(C.id AS c, O.id AS o).')


def overlay_walk(spark, sf_dir):
    """Orders of a diff index (status F) lie over those of the root; files are customers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    file = F.concat(F.lit("c"), F.col("o_custkey"))
    key = F.when(F.col("o_orderstatus") == "F", "diff").otherwise("root")
    node = orders.select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), F.lit("order").alias("type"), F.col("o_orderstatus").alias("name"), F.lit(None).cast("int").alias("index"), F.array("o_orderstatus").alias("search_name"), F.array().cast(PROPS).alias("props"), key.alias("key"), file.alias("path"))
    edge = orders.select(F.lit("of").alias("type"), F.concat(F.lit("order:"), F.col("o_orderkey")).alias("from"), file.alias("to"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("index"), key.alias("key"), file.alias("path"))
    changed = orders.where("o_orderstatus = 'F'").select(file.alias("path"))
    return Engine(GraphSource({"order": node}, {"of": edge}, {}), tabular_registry()).on_overlay("root", "diff", changed).graph('root{type:"order"}.linear_traverse[t["of"]]').select("root", "terminus")


def metadata_upsert(spark, sf_dir):
    """Balances by customer, with the totals of this table's orders in their place."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_acctbal").alias("v"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return catalog.upserted(rows, orders, ["c_custkey"])


def metadata_update(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name")
    changes = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return catalog.updated(suppliers, changes, ["s_nationkey"])


def metadata_lookup(spark, sf_dir):
    """Order lines by a two-column key, less those of a third."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    gone = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return catalog.deleted(catalog.looked_up(lines, wanted, ["l_orderkey", "l_linenumber"]), gone, ["l_partkey"]).groupBy("l_partkey").agg(F.count("*").alias("n"))


def index_delete(spark, sf_dir):
    """Orders stored by status; one index leaves, another loses rows, a third is upserted."""
    store = catalog.IndexStore(spark, shared_folder(spark, "store"))
    schema = "id long, price double, key string"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("key"))
    store.ensure("orders", schema)
    store.append("orders", rows)
    store.delete_key("F", ("orders",))
    store.delete_where("orders", F.col("id") % 3 == 0)
    store.upsert("orders", rows.where("key = 'P' and id % 2 = 0").withColumn("price", F.lit(0.0)))
    return store.read("orders").groupBy("key").agg(F.count("*").alias("n"), F.sum((F.col("price") == 0).cast("long")).alias("zero"))


def directory_listing(spark, sf_dir):
    """Pages by the segments of their addresses."""
    return files.in_listing_order(files.listing(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))))


def tree_changes(spark, sf_dir):
    """What changes from the first lines of orders to the second ones."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tree = lambda n: lines.where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_partkey").alias("blob"))
    return files.tree_diff(tree(1), tree(2))


def snapshot(spark, sf_dir):
    """Plan over the changes of first and second lines, with third lines unsaved."""
    third = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 3").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_returnflag") == "R", "delete").otherwise("modify").alias("change")).groupBy("path").agg(F.min("change").alias("change"))
    return files.snapshot_plan(tree_changes(spark, sf_dir), third, None).groupBy("action").agg(F.count("*").alias("n"))


def branch_summary(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("source", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("size"))
    return files.summary(rows, ["source"])


def _history(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    commits = turns.select(F.col("conv_id").alias("repo"), at(F.col("turn")).alias("sha"), F.when(F.col("turn") > 0, F.array(at(F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"), "turn")
    heads = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.col("conv_id").alias("repo"), F.lit("main").alias("branch"), at(F.col("turn")).alias("sha"))
    return commits, heads


def git_nodes(spark, sf_dir):
    commits, heads = _history(spark, sf_dir)
    nodes, edges = history.git_graph(commits, heads, commits.where("turn = 0").select("repo", "sha", F.col("repo").alias("index_id")))
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.lit("node").alias("what")).unionByName(edges.groupBy("type").agg(F.count("*").alias("n"), F.lit("edge").alias("what")))


def index_plan(spark, sf_dir):
    """For every last turn: the nearest earlier one with a number divisible by 3, in conversations of even number."""
    commits, heads = _history(spark, sf_dir)
    return history.index_plan(commits, heads, commits.where("turn % 3 = 0 and repo % 2 = 0"))


def json_access(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.at_path(F.col("props"), "$.k").cast("long").alias("k"), scalars.at_path(F.col("props"), "$.none").alias("none"))


def row_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", scalars.row_id(F.lit("nation"), F.col("n_nationkey")).alias("id"))


def stream_distinct(spark, sf_dir):
    """A stream over the events, each user's and type's first row appended."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/[e]vents.parquet")
    folder = shared_folder(spark, "stream")
    queues.distinct_stream(stream.select("user_id", "event_type"), ["user_id", "event_type"], f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out")


#: Files that a task extracts.
FILES = 50_000


def _code(spark, sf_dir):
    """A file per event: its type is imported from a module and called with the user's number.

    An event is far smaller than the rows that its file gives, so the events are spread before they become files.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id")
    events = events.repartition(max(spark.sparkContext.defaultParallelism, events.count() // FILES + 1))
    tree = (
        '{"type":"Program","body":[{"type":"ImportDeclaration","source":{"type":"Literal","value":"lib"},"specifiers":[{"type":"ImportSpecifier","imported":{"type":"Identifier","name":"%s"},"local":{"type":"Identifier","name":"f"}}]},'
        '{"type":"FunctionDeclaration","id":{"type":"Identifier","name":"main"},"params":[],"body":{"type":"BlockStatement","body":[{"type":"ReturnStatement","argument":'
        '{"type":"CallExpression","callee":{"type":"Identifier","name":"f"},"arguments":[{"type":"Literal","value":%d}]}}]}}]}'
    )
    files = events.select(F.lit("k").alias("key"), F.lit("r").alias("repo"), F.concat(F.col("event_id"), F.lit(".js")).alias("path"), F.lit("").alias("text"), F.format_string(tree, "event_type", "user_id").alias("ast"))
    return index.extracted(files)


def code_nodes(spark, sf_dir):
    """Nodes and edges of each kind that files give."""
    rows = _code(spark, sf_dir).where("what = 'node' or what = 'edge'")
    return rows.groupBy("type", "what").agg(F.count("*").alias("n"))


def code_logic(spark, sf_dir):
    """Calls of an imported function, with what it is called with and the function around."""
    text = 'javascript::require(E)[name="lib"]. javascript::member(E, D)[name="purchase"]. javascript::call(D, C). javascript::call_arg(C, A)[index=1]. javascript::function_contains(F, C). javascript::function(F)[name="main"]. %SELECT(A.name AS u, F.name AS f, C.path AS path).'
    return Engine(index.stored(_code(spark, sf_dir), shared_folder(spark, "code"))).logic(text)


_MORE = [
    code_nodes, code_logic,
    index_stats, targeted_graph, targeted_relational, targeted_logic, overlay_walk, metadata_upsert, metadata_update, metadata_lookup, index_delete, directory_listing, tree_changes, snapshot, branch_summary, git_nodes, index_plan,
    json_access, row_ids, stream_distinct,
]
_CODE = [*_MORE, collect_group, graph_trace, bounded_repeat, logic_components, order_json_compat, hydrate_extract, hydrate_nearby, checksum, overlay_index, latest_version, stale, running_progress, dedupe_queue, bucket_queue, link_lookups, commit_chain, schema_violations, left_right_full, scalar_helpers]

_END = "CASE WHEN instr(text, chr(10)) > 0 THEN instr(text, chr(10)) - 1 ELSE length(text) END"
_TREES = "WITH a AS (SELECT l_orderkey AS path, min(l_partkey) AS x FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), b AS (SELECT l_orderkey AS path, min(l_partkey) AS y FROM lineitem WHERE l_linenumber = 2 GROUP BY 1), d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN x IS NULL THEN 'add' WHEN y IS NULL THEN 'delete' ELSE 'modify' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE x IS DISTINCT FROM y)"
_PER_FILE = {"node": {"require": 1, "member": 1, "identifier": 2, "function": 1, "return": 1, "call": 1, "identifier-ref": 1, "literal": 1}, "edge": {"member": 1, "declare": 2, "reference": 1, "call": 1, "argument": 1, "return": 1, "function-return": 1, "function-contains": 4}}
_SQL = {
    "code_nodes": " UNION ALL ".join(f"SELECT '{k}' AS type, {n} * count(*) AS n, '{what}' AS what FROM events" for what, kinds in _PER_FILE.items() for k, n in kinds.items()),
    "code_logic": "SELECT user_id::VARCHAR AS u, 'main' AS f, event_id || '.js' AS path FROM events WHERE event_type = 'purchase'",
    "index_stats": " UNION ALL ".join(f"SELECT '{k}' AS type, count(*) AS n FROM {t}" for k, t in (("region", "region"), ("nation", "nation"), ("customer", "customer"), ("supplier", "supplier"), ("part", "part"), ("order", "orders"), ("event", "events"), ("turn", "conversations"), ("document", "documents"))),
    "targeted_graph": "SELECT 'customer:' || o_custkey AS root, 'order:' || o_orderkey AS terminus FROM orders WHERE o_orderstatus = 'F'",
    "targeted_relational": "SELECT 'order:' || o_orderkey AS a, o_orderstatus AS n FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "targeted_logic": "SELECT 'customer:' || o_custkey AS c, 'order:' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'",
    "overlay_walk": "SELECT 'order:' || o_orderkey AS root, 'c' || o_custkey AS terminus FROM orders WHERE o_orderstatus = 'F' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "metadata_upsert": "SELECT c_custkey, coalesce(t, c_acctbal) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "metadata_update": "SELECT s_suppkey, s_nationkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = s_nationkey",
    "metadata_lookup": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1",
    "index_delete": "SELECT o_orderstatus AS key, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS zero FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 3 <> 0 OR o_orderstatus = 'P' AND o_orderkey % 2 = 0) GROUP BY 1",
    "directory_listing": "WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages), e AS (SELECT s, unnest(generate_series(1, len(s))) AS i FROM p) SELECT array_to_string(s[1:i - 1], '/') AS parent, s[i] AS name, bool_or(i < len(s)) AS is_dir, count(*) AS n FROM e GROUP BY 1, 2",
    "tree_changes": f"{_TREES} SELECT path, change FROM d",
    "snapshot": f"{_TREES}, u AS (SELECT l_orderkey AS path, min(CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'modify' END) AS change FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) SELECT CASE WHEN change = 'delete' THEN 'delete' ELSE 'copy' END AS action, count(*) AS n FROM (SELECT * FROM u UNION ALL SELECT * FROM d WHERE path NOT IN (SELECT path FROM u)) GROUP BY 1",
    "branch_summary": "SELECT source, count(*) AS n_files, count(DISTINCT coalesce(lang, '')) AS n_dirs, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "git_nodes": "SELECT 'git-commit' AS type, count(*) AS n, 'node' AS what FROM conversations UNION ALL SELECT 'git-head', count(DISTINCT conv_id), 'node' FROM conversations UNION ALL SELECT 'code-index', count(*), 'node' FROM conversations WHERE turn = 0 UNION ALL SELECT 'git-commit-parent', count(*), 'edge' FROM conversations WHERE turn > 0 UNION ALL SELECT 'git-head-commit', count(DISTINCT conv_id), 'edge' FROM conversations UNION ALL SELECT 'git-commit-index', count(*), 'edge' FROM conversations WHERE turn = 0",
    "index_plan": "SELECT conv_id || ':' || m AS head, CASE WHEN conv_id % 2 = 1 THEN 'root' WHEN m % 3 = 0 THEN 'skip' ELSE 'overlay' END AS action, CASE WHEN conv_id % 2 = 0 THEN conv_id || ':' || (m - m % 3) END AS base, CASE WHEN conv_id % 2 = 0 THEN (m % 3)::INTEGER END AS depth FROM (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1)",
    "json_access": "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.none' AS none FROM events",
    "row_ids": "SELECT n_nationkey, sha256('nation' || chr(31) || n_nationkey) AS id FROM nation",
    "stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "collect_group": "SELECT r_name AS n, string_agg(n_name, ',' ORDER BY n_name) AS l FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "graph_trace": "WITH j AS (SELECT 'supplier:' || s_suppkey AS root, 'nation:' || n_nationkey AS trace_1, 'region:' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT root, trace_1, trace_1 AS trace_2, trace_1 AS terminus FROM j UNION ALL SELECT root, trace_1, r, r FROM j",
    "bounded_repeat": "SELECT 'turn:' || conv_id || ':0' AS a, 'turn:' || conv_id || ':' || turn AS b FROM conversations WHERE turn <= 2",
    "logic_components": "SELECT 'nation:' || n_nationkey AS n, 'region:' || n_regionkey AS r FROM nation UNION ALL SELECT 'part:' || p_partkey, NULL FROM part WHERE p_name LIKE '%steel%'",
    "order_json_compat": "SELECT n_name AS n, count(*) AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1",
    "hydrate_extract": f"SELECT doc_id, substr(text, 1, least(400, {_END})) AS extracted FROM documents WHERE text IS NOT NULL",
    "hydrate_nearby": "SELECT doc_id, CASE WHEN length(c) <= 10000 THEN c END AS nearby, length(c) > 10000 AS truncated FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS c FROM documents WHERE text IS NOT NULL)",
    "checksum": f"SELECT doc_id, base64(unhex(sha256(substr(text, 1, {_END})))) AS checksum FROM documents WHERE text IS NOT NULL",
    "overlay_index": "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, o_custkey AS file, 'root' AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM f) UNION ALL SELECT o_orderkey, o_custkey, 'diff' FROM f",
    "latest_version": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stale": "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1) GROUP BY 1",
    "running_progress": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done, round(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY user_id), 6) AS share FROM events",
    "dedupe_queue": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "bucket_queue": "SELECT user_id, event_id FROM events WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
    "link_lookups": 'SELECT DISTINCT a.l_orderkey AS "from", s_nationkey AS "to" FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber JOIN supplier ON s_suppkey = b.l_suppkey',
    "commit_chain": "SELECT '0:' || turn AS sha, (3 - turn)::INTEGER AS depth FROM conversations WHERE conv_id = 0 AND turn <= 3 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 0 AND turn = 3)",
    "schema_violations": "SELECT 'supplier:' || s_suppkey AS \"from\", 'supp_nation' AS type, 'nation:' || s_nationkey AS \"to\" FROM supplier",
    "left_right_full": "SELECT coalesce(l, 0) AS l, coalesce(r, 0) AS r, count(*) AS n FROM (SELECT o_orderkey AS k, 1 AS l FROM orders WHERE o_orderstatus = 'F') AS a FULL JOIN (SELECT l_orderkey AS k, 1 AS r FROM lineitem WHERE l_linenumber = 1) AS b USING (k) GROUP BY 1, 2",
    "scalar_helpers": "SELECT page_id, '-1/a/b/' || page_id || '/7' AS key, page_id::INTEGER AS repo, 'L1:2-L3:4' AS shown, replace(url_encode(url), '%20', '+') AS url FROM pages",
}


def _text_query(kind: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: (engine(spark, sf_dir).logic if kind == "l" else engine(spark, sf_dir).relational)(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text_query(kind, text) for name, (kind, text, _) in _TEXTS.items()} | {f.__name__: f for f in _CODE}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in _TEXTS.items()} | _SQL
