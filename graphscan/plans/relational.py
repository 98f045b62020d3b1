"""Relational queries as one lazy DataFrame plan.

A variable is a column ``<name>__id`` (null where a left join found nothing)
and those of its node's members that the query uses.  What a trace gives
depends only on the node it starts from, so a left join is a join with the
walk from the different start nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..lang.tree import Call, Column, Graph, Member, QueryError, Relational
from ..operators.predicates import node_condition
from ..operators.traverse import end_types, follow_steps, hop_table, single_hop
from ..sources.graph import GraphSource

_HYDRATED = {"extracted": ("key", "path", "start_index", "end_index"), "repo": ("repo",)}


def _members(items) -> dict[str, set[str]]:
    """Node columns that each variable needs."""
    out: dict[str, set[str]] = {}

    def visit(item) -> None:
        if isinstance(item, Member):
            own = out.setdefault(item.column, set())
            own.update(m for m in _HYDRATED.get(item.member, (item.member,)) if m != "id")
        elif isinstance(item, Call):
            for a in item.args:
                visit(a)

    for item in items:
        visit(item)
    return out


def _label(item, number: int) -> str:
    if isinstance(item, Column):
        return item.name
    if isinstance(item, Member):
        return item.alias or f"{item.column}.{item.member}"
    return item.alias or f"op_{number}"


def topological(query: Relational) -> list:
    """Traces so that each follows the one that makes its start; ``%ordering`` decides among the ready ones."""
    rank = {k: i for i, k in enumerate(query.ordering)}
    known, left, out = {query.root}, list(query.traces), []
    names = [query.root, *(t.name for t in left)]
    if len(set(names)) < len(names):
        raise QueryError("key.repeat", "a name is used twice")
    for t in left:
        if t.source not in names:
            raise QueryError("from.dne", f"no {t.source} to trace from")
    while left:
        ready = sorted((t for t in left if t.source in known), key=lambda t: rank.get(t.name, len(rank)))
        if not ready:
            raise QueryError("invalid.cycle", "traces start from one another")
        out.append(ready[0])
        known.add(ready[0].name)
        left.remove(ready[0])
    return out


def root_scan(source: GraphSource, graph: Graph, members: list[str]) -> tuple[DataFrame, set[str] | None]:
    if graph.file:
        source_of_root = source.only_files(graph.file)
    else:
        source_of_root = source
    types = set(graph.root.types) or ({i.split(":")[0] for i in graph.root.ids} if graph.root.ids and source.ends else None)
    nodes = source_of_root.nodes(sorted(types) if types else None, graph.root.not_types, graph.root.ids).where(node_condition(graph.root, source.single_names))
    if graph.traverses:
        rows = follow_steps(nodes.select(F.col("id").alias("at")), source, graph.traverses, types, members)
        return rows, end_types(source, types, graph.traverses)
    return nodes.select(F.col("id").alias("at"), *[F.col(m).alias(f"_m_{m}") for m in members]), types


def graph_paths(source: GraphSource, graph: Graph) -> DataFrame:
    """root, trace_1 ... terminus ids of a path query, a column for each walk."""
    types = set(graph.root.types) or None
    nodes = source.only_files(graph.file) if graph.file else source
    rows = nodes.nodes(sorted(types) if types else None, graph.root.not_types).where(node_condition(graph.root)).select(F.col("id").alias("root"), F.col("id").alias("at"))
    n = 0
    for step in graph.traverses:
        rows = follow_steps(rows, source, [step], types, [])
        types = end_types(source, types, [step])
        if type(step).__name__ != "NodeCheck":
            n += 1
            rows = rows.withColumn(f"trace_{n}", F.col("at"))
    return rows.withColumnRenamed("at", "terminus")


def joined(source: GraphSource, query: Relational) -> DataFrame:
    """All variables side by side, filters applied, nothing selected yet."""
    members = {k: sorted(v) for k, v in _members(query.items).items()}
    take = lambda name, rows: rows.select(*[c for c in rows.columns if c != "at" and not c.startswith("_m_")], F.col("at").alias(f"{name}__id"), *[F.col(f"_m_{m}").alias(f"{name}__{m}") for m in members.get(name, [])])
    rows, types = root_scan(source, query.graph, members.get(query.root, []))
    rows = take(query.root, rows)
    kinds = {query.root: types}
    for trace in topological(query):
        at = f"{trace.source}__id"
        own = members.get(trace.name, [])
        kinds[trace.name] = end_types(source, kinds[trace.source], trace.traverses)
        if trace.left or any(t.left and t.name == trace.source for t in query.traces):
            hop = single_hop(trace.traverses[0]) if trace.traverses else None
            if hop is not None:  # the edges themselves are the other side, so the rows are planned once
                starts, steps, types = hop_table(source, hop), trace.traverses[1:], end_types(source, kinds[trace.source], trace.traverses[:1])
            else:
                starts, steps, types = rows.where(F.col(at).isNotNull()).select(F.col(at).alias("_from")).distinct().withColumn("at", F.col("_from")), trace.traverses, kinds[trace.source]
            ends = take(trace.name, follow_steps(starts, source, steps, types, own))
            rows = rows.join(ends, rows[at] == ends["_from"], "left" if trace.left else "inner").drop("_from")
        else:
            rows = take(trace.name, follow_steps(rows.withColumn("at", F.col(at)), source, trace.traverses, kinds[trace.source], own))
    present = lambda k, there: F.col(f"{k}__id").isNotNull() if there else F.col(f"{k}__id").isNull()
    for k, there in query.having:
        rows = rows.where(present(k, there))
    if query.having_or:
        rows = rows.where(reduce(lambda a, b: a | b, [present(k, there) for k, there in query.having_or]))
    for names in query.intersect:
        first = F.col(f"{names[0]}__id")
        rows = rows.where(reduce(lambda a, b: a & b, [first.eqNullSafe(F.col(f"{n}__id")) for n in names[1:]]))
    if query.scroll:
        rows = rows.where(_from_cursor(query.scroll))
    return rows


def _from_cursor(scroll) -> SparkColumn:
    """Rows at or after the cursor: (variable's id ...) in the order of the cursor's variables."""
    keys = [(F.col(f"{name}__id"), values[-1]) for name, values in scroll]
    out = F.lit(True)
    for c, v in reversed(keys):
        out = (c > v) | ((c == v) & out)
    return out


def _hydrate(rows: DataFrame, source: GraphSource, items) -> DataFrame:
    """Adds ``<name>__extracted`` where it is selected: one join with the files for each such variable."""
    wanted: set[str] = set()

    def visit(item) -> None:
        if isinstance(item, Member) and item.member == "extracted":
            wanted.add(item.column)
        for a in getattr(item, "args", ()):
            visit(a)

    for item in items:
        visit(item)
    for name in sorted(wanted):
        if source.files is None:
            raise QueryError("invalid.files", "this graph has no texts")
        files = source.files.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.col("text").alias("_text"))
        rows = rows.join(files, (F.col(f"{name}__key") == F.col("_key")) & (F.col(f"{name}__path") == F.col("_path")), "left")
        rows = rows.withColumn(f"{name}__extracted", scalars.extracted(F.col("_text"), F.col(f"{name}__start_index"), F.col(f"{name}__end_index"))).drop("_key", "_path", "_text")
    return rows


def _value(item) -> SparkColumn:
    if isinstance(item, Column):
        return F.col(f"{item.name}__id")
    if isinstance(item, Member):
        return F.col(f"{item.column}__{item.member}")
    return (scalars.cat if item.function == "CAT" else scalars.path_cat)(*[_value(a) for a in item.args])


def run(source: GraphSource, query: Relational, compat: bool = False) -> DataFrame:
    """The query's result.  ``compat`` takes OFFSET and LIMIT before grouping and orders by text."""
    names = {query.root, *(t.name for t in query.traces)}
    _check(query, names)
    rows = _hydrate(joined(source, query), source, query.items)
    ids = [f"{n}__id" for n in sorted(names)]
    grouped = any(isinstance(i, Call) and i.aggregate for i in query.items)
    labels = [_label(i, n) for n, i in enumerate(query.items)]
    page = query.offset is not None or query.limit is not None
    if page and (compat and (grouped or query.order_by)):
        rows = _page(rows.orderBy(*ids), query)
    if grouped:
        keys = [(i, label) for i, label in zip(query.items, labels) if not (isinstance(i, Call) and i.aggregate)]
        totals = []
        for i, label in zip(query.items, labels):
            if isinstance(i, Call) and i.aggregate:
                if i.function == "COUNT":
                    totals.append((F.count(F.lit(1)) * len(i.args)).alias(label))
                else:
                    # a struct keeps nulls in the list
                    lists = [F.collect_list(F.struct(_value(a).alias("v"))) for a in i.args]
                    totals.append(F.transform(F.concat(*lists), lambda s: s["v"]).alias(label))
        out = rows.groupBy(*[_value(i).alias(label) for i, label in keys]).agg(*totals) if keys else rows.agg(*totals)
        out = out.select(*[F.col(f"`{label}`") for label in labels])
    else:
        values = [_value(i).alias(label) for i, label in zip(query.items, labels)]
        if query.order_by:
            out = rows.select(*values).distinct()  # ordering implies different rows
        elif page:
            rows = _page(rows.orderBy(*ids), query)
            return rows.select(*values)
        else:
            return rows.select(*values)
    if query.order_by:
        order = []
        for k, down in query.order_by:
            c = F.to_json(F.struct(F.col(f"`{k}`"))) if compat else F.col(f"`{k}`")
            order.append(c.desc() if down else c.asc())
        out = out.orderBy(*order, *[F.col(f"`{label}`") for label in labels if out.schema[label].dataType.typeName() != "array"])
    elif page and not compat:
        out = out.orderBy(*[F.col(f"`{label}`") for label in labels if out.schema[label].dataType.typeName() != "array"])
    return _page(out, query) if page and not compat else out


def _page(rows: DataFrame, query: Relational) -> DataFrame:
    if query.offset is not None:
        rows = rows.offset(query.offset)
    return rows.limit(query.limit) if query.limit is not None else rows


def _check(query: Relational, names: set[str]) -> None:
    def visit(item) -> None:
        if isinstance(item, Call):
            for a in item.args:
                visit(a)
        elif (item.name if isinstance(item, Column) else item.column) not in names:
            raise QueryError("invalid.select", f"{item} is not bound")

    for item in query.items:
        visit(item)
    labels = [_label(i, n) for n, i in enumerate(query.items)]
    for k, _ in query.order_by:
        if k not in labels:
            raise QueryError("invalid.orderby", f"{k} is not selected")
    for k in [k for k, _ in query.having + query.having_or] + [k for ks in query.intersect for k in ks]:
        if k not in names:
            raise QueryError("invalid.having", f"{k} is not bound")
