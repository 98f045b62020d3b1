"""The driver's tables as one property graph.

| nodes | id, name, index | edges | from -> to, label |
|-|-|-|-|
| region, nation, customer, supplier, part | key, name, part size | in_region, cust_nation, supp_nation | key columns, market segment |
| order, event, turn, document | key, status / type / role / language | placed, contains, shipped_by, next_turn | status; flag or line status and line number |

Every table is read with the columns a query needs only; edge tables hold
different edges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PROPS, GraphSource


def _nodes(df: DataFrame, kind: str, key, name=None, index=None, props: dict | None = None, path=None, raw=None) -> DataFrame:
    name = F.lit(None).cast("string") if name is None else F.col(name)
    pairs = [F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value")) for k, v in (props or {}).items()]
    return df.select(
        *[c.alias("_raw") for c in ([raw] if raw is not None else [])], F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), (F.lit(None) if index is None else F.col(index)).cast("int").alias("index"),
        F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>")).alias("search_name"), (F.array(*pairs) if pairs else F.array()).cast(PROPS).alias("props"),
        F.lit("tables").alias("key"), (F.lit(kind) if path is None else path).alias("path"),
    )


def _edges(df: DataFrame, kind: str, a, b, name=None, index=None) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), a.alias("from"), b.alias("to"), (F.lit(None) if name is None else F.col(name)).cast("string").alias("name"), (F.lit(None) if index is None else F.col(index)).cast("int").alias("index"), F.lit("tables").alias("key"))


def tabular_graph(spark: SparkSession, sf_dir: str) -> GraphSource:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda *cs: F.concat_ws(":", *[F.col(c).cast("string") for c in cs])
    at = lambda kind, *cs: F.concat(F.lit(f"{kind}:"), text(*cs))
    nodes = {
        "region": lambda: _nodes(t("region"), "region", text("r_regionkey"), "r_name", raw=F.col("r_regionkey")),
        "nation": lambda: _nodes(t("nation"), "nation", text("n_nationkey"), "n_name", raw=F.col("n_nationkey")),
        "customer": lambda: _nodes(t("customer"), "customer", text("c_custkey"), "c_name", props={"segment": "c_mktsegment"}, raw=F.col("c_custkey")),
        "supplier": lambda: _nodes(t("supplier"), "supplier", text("s_suppkey"), "s_name", raw=F.col("s_suppkey")),
        "part": lambda: _nodes(t("part"), "part", text("p_partkey"), "p_name", "p_size", {"brand": "p_brand", "type": "p_type"}, raw=F.col("p_partkey")),
        "order": lambda: _nodes(t("orders"), "order", text("o_orderkey"), "o_orderstatus", props={"priority": "o_orderpriority"}, raw=F.col("o_orderkey")),
        "event": lambda: _nodes(t("events"), "event", text("event_id"), "event_type", raw=F.col("event_id")),
        "turn": lambda: _nodes(t("conversations"), "turn", text("conv_id", "turn"), "role", "turn"),
        "document": lambda: _nodes(t("documents"), "document", text("doc_id"), "lang", path=F.concat(text("doc_id"), F.lit(".txt")), raw=F.col("doc_id")),
    }
    line = lambda *cs: t("lineitem").select(*cs).distinct()
    edges = {
        "in_region": lambda: _edges(t("nation"), "in_region", at("nation", "n_nationkey"), at("region", "n_regionkey")),
        "cust_nation": lambda: _edges(t("customer"), "cust_nation", at("customer", "c_custkey"), at("nation", "c_nationkey"), "c_mktsegment"),
        "supp_nation": lambda: _edges(t("supplier"), "supp_nation", at("supplier", "s_suppkey"), at("nation", "s_nationkey")),
        "placed": lambda: _edges(t("orders"), "placed", at("customer", "o_custkey"), at("order", "o_orderkey"), "o_orderstatus"),
        "contains": lambda: _edges(line("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber"), "contains", at("order", "l_orderkey"), at("part", "l_partkey"), "l_returnflag", "l_linenumber"),
        "shipped_by": lambda: _edges(line("l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber"), "shipped_by", at("order", "l_orderkey"), at("supplier", "l_suppkey"), "l_linestatus", "l_linenumber"),
        "next_turn": lambda: _edges(t("conversations").withColumn("n", F.col("turn") + 1).join(t("conversations").select("conv_id", F.col("turn").alias("n")), ["conv_id", "n"]), "next_turn", at("turn", "conv_id", "turn"), at("turn", "conv_id", "n")),
    }
    ends = {"in_region": ("nation", "region"), "cust_nation": ("customer", "nation"), "supp_nation": ("supplier", "nation"), "placed": ("customer", "order"), "contains": ("order", "part"), "shipped_by": ("order", "supplier"), "next_turn": ("turn", "turn")}
    files = lambda: t("documents").select(F.lit("tables").alias("key"), F.concat(text("doc_id"), F.lit(".txt")).alias("path"), "text")
    return GraphSource(nodes, edges, ends, files, _narrow, True)


def _narrow(kind: str, table: DataFrame, ids: list[str]) -> DataFrame:
    """The table less what its whole-number key column rules out, which a scan can skip; the column is dropped."""
    if "_raw" not in table.columns:
        return table
    mine = [i.split(":", 1)[1] for i in ids if i.startswith(f"{kind}:")]
    numbers = [int(x) for x in mine if re.fullmatch(r"-?\d{1,18}", x)]
    return table.where(F.col("_raw").isin(*numbers) if numbers else F.lit(False)).drop("_raw")
