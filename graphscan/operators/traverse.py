"""Walks along regular path expressions over edge tables.

A walk takes a DataFrame with the column ``at`` (a node id) and gives its rows
once for every accepted path, ``at`` moved to the path's end.  An expression
without a loop is a fixed chain of joins and unions and runs no job; one with
a loop runs a job for each depth, each frontier checkpointed, until no row is
left.  A path may not come to the same node in the same state twice, so walks
over cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.tree import EdgeType, Linear, NodeCheck, Repeated
from ..plans.automaton import Automaton
from ..sources.graph import GraphSource
from ..sources.shared import shared_base
from .predicates import edge_condition, node_condition


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder all executors share, its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def _hop(rows: DataFrame, source: GraphSource, edge: EdgeType, keep_path: bool) -> DataFrame:
    table = source.edges(edge.type).where(edge_condition(edge))
    here, there = ("to", "from") if edge.reverse else ("from", "to")
    shown = F.concat_ws("\x1f", F.lit(edge.type + ("<" if edge.reverse else ">")), F.col(there), F.coalesce("name", F.lit("\x00")), F.coalesce(F.col("index").cast("string"), F.lit("\x00")))
    columns = [F.col(here).alias("_here"), F.col(there).alias("_there")] + ([shown.alias("_hop")] if keep_path else [])
    return rows.join(table.select(*columns), rows["at"] == F.col("_here")).drop("_here")


def walk(rows: DataFrame, source: GraphSource, step: Linear | Repeated, deepest: int | None = None) -> DataFrame:
    """All accepted paths from ``at``; ``deepest`` bounds the number of hops."""
    machine = Automaton(step)
    if machine.loops:
        return _walk_loop(rows, source, machine, deepest)
    keep_path = machine.ambiguous
    if keep_path:
        starts = rows.select("at").distinct().select(F.col("at").alias("_start"), "at", F.array().cast("array<string>").alias("_path"))
        ends = _unrolled(starts, source, machine, True, deepest).dropDuplicates(["_start", "_path"]).select("_start", F.col("at").alias("_end"))
        return rows.join(ends, rows["at"] == F.col("_start")).drop("at", "_start").withColumnRenamed("_end", "at").select(*rows.columns)
    return _unrolled(rows, source, machine, False, deepest)


def _unrolled(rows: DataFrame, source: GraphSource, machine: Automaton, keep_path: bool, deepest: int | None) -> DataFrame:
    columns = rows.columns
    out = [rows] if 0 in machine.accepts else []
    frontier: dict[int, DataFrame] = {0: rows}
    depth = 0
    while frontier and (deepest is None or depth < deepest):
        following: dict[int, list[DataFrame]] = {}
        for state, df in frontier.items():
            for edge, nxt in machine.moves[state]:
                moved = _hop(df, source, edge, keep_path)
                if keep_path:
                    moved = moved.withColumn("_path", F.concat("_path", F.array("_hop"))).drop("_hop")
                following.setdefault(nxt, []).append(moved.drop("at").withColumnRenamed("_there", "at").select(*columns))
        frontier = {s: reduce(DataFrame.unionByName, dfs) for s, dfs in following.items()}
        out += [df for s, df in frontier.items() if s in machine.accepts]
        depth += 1
    return reduce(DataFrame.unionByName, out) if out else rows.where(F.lit(False))


def _walk_loop(rows: DataFrame, source: GraphSource, machine: Automaton, deepest: int | None) -> DataFrame:
    def seen(state, node):
        """(state, node) for every state that ``state`` stands for."""
        states = reduce(lambda c, s: c.when(state == s, F.array(*[F.lit(n) for n in machine.stands_for[s]])), machine.moves, F.when(F.lit(False), F.array().cast("array<int>")))
        return F.transform(states, lambda n: F.concat_ws("\x1f", n.cast("string"), node))

    frontier = rows.select("at").distinct().select(
        F.col("at").alias("_start"), "at", F.lit(0).alias("_state"), F.array().cast("array<string>").alias("_path"), seen(F.lit(0), F.col("at")).alias("_seen")
    )
    frontier = checkpointed(frontier)
    accepted = lambda df: df.where(F.col("_state").isin(*sorted(machine.accepts))).select("_start", "at", "_path")
    found, depth = [accepted(frontier)], 0
    while (deepest is None or depth < deepest) and not frontier.isEmpty():
        parts = []
        for edge, nexts in machine.by_edge(set(machine.moves)).items():
            into = reduce(lambda c, s: c.when(F.col("_state") == s, F.array(*[F.lit(n) for n in nexts[s]])), list(nexts), F.when(F.lit(False), F.array().cast("array<int>")))
            moved = _hop(frontier.where(F.col("_state").isin(*nexts)), source, edge, True).withColumn("_next", F.explode(into))
            parts.append(moved.where(F.size(F.array_except(seen(F.col("_next"), F.col("_there")), "_seen")) > 0))
        following = reduce(DataFrame.unionByName, parts).select(
            "_start", F.col("_there").alias("at"), F.col("_next").alias("_state"), F.concat("_path", F.array("_hop")).alias("_path"), F.concat("_seen", seen(F.col("_next"), F.col("_there"))).alias("_seen")
        )
        frontier = checkpointed(following.dropDuplicates(["_start", "_path", "_state"]))
        found.append(accepted(frontier))
        depth += 1
    ends = reduce(DataFrame.unionByName, found).dropDuplicates(["_start", "_path"]).select("_start", F.col("at").alias("_end"))
    return rows.join(ends, rows["at"] == F.col("_start")).drop("at", "_start").withColumnRenamed("_end", "at").select(*rows.columns)


def end_types(source: GraphSource, types: set[str] | None, steps) -> set[str] | None:
    """Types that nodes at the end of some steps can have (None: any)."""
    for step in steps:
        if isinstance(step, NodeCheck):
            if step.setting.types:
                types = set(step.setting.types) if types is None else types & set(step.setting.types)
            continue
        machine = Automaton(step)
        out: set[str] = set()
        for state, moves in machine.moves.items():
            for edge, nxt in moves:
                if nxt in machine.accepts:
                    if edge.type not in source.ends:
                        return None
                    out.add(source.ends[edge.type][0 if edge.reverse else 1])
        if 0 in machine.accepts:
            out = None if types is None else out | types
        types = out
    return types


def single_hop(step) -> EdgeType | None:
    """The edge of a step that is one obligatory hop along one edge type."""
    if isinstance(step, Linear) and len(step.follows) == 1 and step.follows[0].kind == "t" and len(step.follows[0].edges) == 1:
        return step.follows[0].edges[0]
    return None


def hop_table(source: GraphSource, edge: EdgeType) -> DataFrame:
    """(_from, at) of every edge that a hop may take, each different edge once."""
    here, there = ("to", "from") if edge.reverse else ("from", "to")
    return source.edges(edge.type).where(edge_condition(edge)).select(F.col(here).alias("_from"), F.col(there).alias("at"))


def follow_steps(rows: DataFrame, source: GraphSource, steps, types: set[str] | None, members: list[str]) -> DataFrame:
    """Rows after some steps, with the wanted members of the nodes they end at as ``_m_<member>``."""
    for i, step in enumerate(steps):
        if isinstance(step, NodeCheck):
            last = i == len(steps) - 1
            types = end_types(source, types, [step])
            nodes = source.nodes(sorted(types) if types else None, step.setting.not_types).where(node_condition(step.setting))
            wanted = members if last else []
            rows = rows.join(nodes.select(F.col("id").alias("_id"), *[F.col(m).alias(f"_m_{m}") for m in wanted]), rows["at"] == F.col("_id"), "inner" if wanted else "left_semi").drop("_id")
            if last:
                return rows
        else:
            rows = walk(rows, source, step)
            types = end_types(source, types, [step])
    if members:
        nodes = source.nodes(sorted(types) if types else None).select(F.col("id").alias("_id"), *[F.col(m).alias(f"_m_{m}") for m in members])
        rows = rows.join(nodes, rows["at"] == F.col("_id")).drop("_id")
    return rows
