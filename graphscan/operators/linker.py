"""Operators of the write side: linking, merge joins, bad edges, commit chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.tree import EdgeType, Follow, Linear
from ..sources.graph import GraphSource
from .traverse import walk

#: Rows of lookups and definitions in a partition of their join.
PART_ROWS = 500_000


def link(lookups: DataFrame, definitions: DataFrame, symbols: DataFrame, kind: str = "call-link") -> DataFrame:
    """Edges from looked-up nodes to the nodes defined where the language service points.

    lookups (node_id, path, index), definitions (path, index, def_path, start_index, end_index), symbols (path, start_index, end_index, node_id).
    Lookups and definitions are counted first; a partition takes about ``PART_ROWS`` of them.
    """
    d = definitions.select("path", "index", "def_path", "start_index", "end_index")
    s = symbols.select(F.col("path").alias("def_path"), "start_index", "end_index", F.col("node_id").alias("to"))
    parts = max(int(lookups.sparkSession.conf.get("spark.sql.shuffle.partitions")), (lookups.count() + definitions.count()) // PART_ROWS + 1)
    # what is defined at a place comes first, so that many definitions of one node meet the lookups once
    there = d.join(s, ["def_path", "start_index", "end_index"]).select("path", "index", "to").repartition(parts, "path", "index").dropDuplicates(["path", "index", "to"])
    found = lookups.select(F.col("node_id").alias("from"), "path", "index").repartition(parts, "path", "index").join(there, ["path", "index"]).select("from", "to")
    # rows are spread before they are made distinct: what a task holds does not grow with the tables
    pairs = found.repartition(parts, "from").dropDuplicates(["from", "to"])
    return pairs.select(F.lit(kind).alias("type"), "from", "to", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("index"))


def without_bad_edges(edges: DataFrame) -> DataFrame:
    """Edges that have both ends."""
    return edges.where((F.coalesce("from", F.lit("")) != "") & (F.coalesce("to", F.lit("")) != ""))


def keyed_join(left: DataFrame, right: DataFrame, key: str = "key", left_outer: bool = False, right_outer: bool = False) -> DataFrame:
    """The cross product per key, unmatched rows of the outer sides kept."""
    how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[left_outer, right_outer]
    return left.join(right, key, how)


def commit_chain(commits: DataFrame, head: str, limit: int = 20) -> DataFrame:
    """A commit and those it stems from, at most ``limit`` hops away: sha, depth by the shortest way."""
    edges = commits.select(F.lit("parent").alias("type"), F.col("sha").alias("from"), F.explode("parents").alias("to"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("index"))
    source = GraphSource({"commit": commits.select(F.col("sha").alias("id"))}, {"parent": edges.distinct()})
    step = Linear((Follow("t", (EdgeType("parent"),)),))
    rows = commits.where(F.col("sha") == head).select(F.col("sha").alias("at"), F.lit(0).alias("depth"))
    out = rows
    for depth in range(1, limit + 1):
        rows = walk(rows.select("at").distinct(), source, step).select("at", F.lit(depth).alias("depth")).distinct()
        out = out.unionByName(rows)
    return out.groupBy(F.col("at").alias("sha")).agg(F.min("depth").alias("depth"))


def schema_violations(nodes: DataFrame, edges: DataFrame, legal: DataFrame) -> DataFrame:
    """Edges whose (from type, type, to type) is not among the legal triples (null: any)."""
    ends = lambda side: nodes.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type"))
    typed = edges.join(ends("from"), "from").join(ends("to"), "to")
    # types that occur, not edges, meet the vocabulary: at most the product of its words
    kinds = typed.select("from_type", "type", "to_type").distinct()
    fits = (kinds["type"] == legal["type"]) & (legal["from_type"].isNull() | (kinds["from_type"] == legal["from_type"])) & (legal["to_type"].isNull() | (kinds["to_type"] == legal["to_type"]))
    wrong = kinds.join(legal, fits, "left_anti")
    same = [typed[c].eqNullSafe(wrong[c]) for c in ("from_type", "type", "to_type")]
    return typed.join(wrong, same, "left_semi")
