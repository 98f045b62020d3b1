"""Property graphs as DataFrames, and which part of one a query reads.

Node columns: id, type, name, index, search_name, props, key, path; others
(repo, positions) may follow.  Edge columns: type, from, to, name, index, key.
Tables may be given whole or by type; by type, a scan of some types reads
those tables only.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "type", "name", "index", "search_name", "props", "key", "path")
EDGE_COLUMNS = ("type", "from", "to", "name", "index", "key")
PROPS = "array<struct<key:string,value:string>>"


class GraphSource:
    """Nodes and edges by type (``None``: a whole table with a type column).

    A table may be a function that makes it; it is called when a query first reads it.
    """

    def __init__(self, nodes: dict[str | None, DataFrame], edges: dict[str | None, DataFrame], ends: dict[str, tuple[str, str]] | None = None, files: DataFrame | None = None, narrow=None, single_names: bool = False):
        """``narrow`` (type, table, ids) may filter a table by its own key columns to those that can have one of the ids;
        ``single_names`` says that a node's search names are its name."""
        self._nodes, self._edges, self.ends, self._files = nodes, edges, ends or {}, files
        self.narrow, self.single_names = narrow, single_names

    @staticmethod
    def _made(tables: dict, kind) -> DataFrame:
        if callable(tables[kind]):
            tables[kind] = tables[kind]()
        return tables[kind]

    @property
    def files(self) -> DataFrame | None:
        if callable(self._files):
            self._files = self._files()
        return self._files

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> GraphSource:
        return cls({None: nodes}, {None: edges.dropDuplicates(["type", "from", "to", "name", "index"])}, None, files)

    @classmethod
    def _pick(cls, tables: dict, types: Iterable[str] | None, leave: Iterable[str] = ()) -> DataFrame:
        whole = tables.get(None)
        if whole is not None:
            if types:
                whole = whole.where(F.col("type").isin(*types))
            return whole.where(~F.col("type").isin(*leave)) if leave else whole
        chosen = [cls._made(tables, k) for k in list(tables) if (not types or k in types) and k not in leave]
        if not chosen:
            return cls._made(tables, next(iter(tables))).where(F.lit(False))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)

    def nodes(self, types: Iterable[str] | None = None, leave: Iterable[str] = (), ids: Iterable[str] = ()) -> DataFrame:
        """Nodes of some types (None: all); ``ids`` lets tables be narrowed to them, and does not replace the condition."""
        ids = list(ids)
        if ids and self.narrow:
            return self._pick({k: (lambda k=k: self.narrow(k, self._made(self._nodes, k), ids)) for k in self._nodes}, types, leave)
        return self._pick(self._nodes, types, leave)

    def edges(self, kind: str) -> DataFrame:
        """Different edges of one type: a path is known by what its hops show."""
        return self._pick(self._edges, [kind])

    def map_tables(self, on_nodes, on_edges=None) -> GraphSource:
        """The same graph with every node (and edge) table changed."""
        later = lambda tables, k, change: lambda: change(self._made(tables, k))
        nodes = {k: on_nodes(v) if k is None else later(self._nodes, k, on_nodes) for k, v in self._nodes.items()}
        edges = dict(self._edges) if on_edges is None else {k: on_edges(v) if k is None else later(self._edges, k, on_edges) for k, v in self._edges.items()}
        return GraphSource(nodes, edges, self.ends, self._files, self.narrow, self.single_names)

    def only_files(self, pattern: str) -> GraphSource:
        """Root nodes whose path matches: one pattern with ``*``, or a list of paths."""
        if "*" in pattern:
            from ..operators.predicates import text_match

            return self.map_tables(lambda t: t.where(text_match(F.col("path"), [pattern])))
        return self.map_tables(lambda t: t.where(F.col("path").isin(*[p.strip() for p in pattern.split(",")])))

    def only_keys(self, keys: Iterable[str]) -> GraphSource:
        keys = list(keys)
        keep = lambda t: t.where(F.col("key").isin(*keys))
        return self.map_tables(keep, keep)

    def only_org(self, org) -> GraphSource:
        """Nodes and edges of one organisation, for graphs whose tables have ``org_id``."""
        keep = lambda t: t.where(F.col("org_id") == org)
        return self.map_tables(keep, keep)

    def overlaid(self, root_key: str, diff_key: str, changed: DataFrame) -> GraphSource:
        """The graph of a diff index over its root: of files that changed (path) the diff's nodes and edges, of others the root's.

        Edges belong to a file if they have ``path``; without it they go by the nodes they start from.
        """
        nodes = lambda t: overlay(t, root_key, diff_key, changed)
        starts = lambda: overlay(self.nodes(), root_key, diff_key, changed).select(F.col("id").alias("from"), "key")
        edges = lambda t: overlay(t, root_key, diff_key, changed) if "path" in t.columns else t.join(starts(), ["from", "key"], "left_semi").select(*t.columns)
        return self.map_tables(nodes, edges)


def overlay(rows: DataFrame, root_key: str, diff_key: str, changed: DataFrame) -> DataFrame:
    """Rows of a diff index over its root: the root's rows of files that did not change, and the diff's."""
    root = rows.where(F.col("key") == root_key).join(changed.select("path").distinct(), "path", "left_anti")
    return root.unionByName(rows.where(F.col("key") == diff_key))


def latest_per(versions: DataFrame, by: str, created: str, tie: str) -> DataFrame:
    """The newest row of each group."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(created), F.desc(tie)))
    return versions.withColumn("_place", place).where("_place = 1").drop("_place")


def stale_versions(versions: DataFrame, by: list[str], created: str, tie: str) -> DataFrame:
    """All but the newest row of each group, for deletion."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(created), F.desc(tie)))
    return versions.withColumn("_place", place).where("_place > 1").drop("_place")
