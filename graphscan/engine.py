"""The engine: texts of the three languages to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars
from .lang import parse, show
from .lang.tree import Setting
from .operators.predicates import node_condition
from .plans import compiler, relational
from .plans.registry import Registry, code_registry
from .sources.graph import GraphSource


class Engine:
    def __init__(self, source: GraphSource, registry: Registry | None = None):
        self.source, self.registry = source, registry or code_registry()
        self._counts: dict[Setting, int] = {}

    def on_keys(self, keys: list[str]) -> Engine:
        """The same engine over some indexes only; their key column is what tables are partitioned by."""
        return Engine(self.source.only_keys(keys), self.registry)

    def on_org(self, org) -> Engine:
        return Engine(self.source.only_org(org), self.registry)

    def on_overlay(self, root_key: str, diff_key: str, changed: DataFrame) -> Engine:
        """The same engine over a diff index that lies over its root."""
        return Engine(self.source.overlaid(root_key, diff_key, changed), self.registry)

    def graph(self, text: str) -> DataFrame:
        """Ids at the root, after each walk and at the end of a path query."""
        return relational.graph_paths(self.source, parse.parse_graph(text))

    def relational(self, text: str, compat: bool = False) -> DataFrame:
        return relational.run(self.source, parse.parse_relational(text), compat)

    def count(self, setting: Setting) -> int:
        """Nodes that a setting matches, counted once."""
        if setting not in self._counts:
            nodes = self.source.nodes(setting.types or None, setting.not_types).where(node_condition(setting))
            self._counts[setting] = nodes.count()
        return self._counts[setting]

    def compile(self, text: str) -> list[str]:
        """Relational texts of a logic query, one per connected part."""
        return [show.relational(q) for q in compiler.compile_logic(parse.parse_logic(text), self.registry, self.count)]

    def logic(self, text: str, part: int = 0) -> DataFrame:
        return relational.run(self.source, compiler.compile_logic(parse.parse_logic(text), self.registry, self.count)[part])

    def explain(self, text: str) -> str:
        df = self.relational(text)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def hydrate(self, rows: DataFrame, key: str = "key", path: str = "path", positions: tuple[str, str, str, str] = ("start_index", "end_index", "start_line", "end_line")) -> DataFrame:
        """Text, nearby lines, their cut flag and a checksum beside rows that carry a file and positions."""
        files = self.source.files.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.col("text").alias("_text"))
        a, b, c, d = (F.col(p) for p in positions)
        text = F.col("_text")
        found = rows.join(files, (rows[key] == F.col("_key")) & (rows[path] == F.col("_path")))
        return found.withColumns({
            "extracted": scalars.extracted(text, a, b), "nearby": scalars.nearby(text, c, d), "truncated": scalars.nearby(text, c, d).isNull(), "checksum": scalars.checksum(text, a, b),
        }).drop("_key", "_path", "_text")

    def results(self, rows: DataFrame):
        """A header row, then JSON lines, one at a time."""
        yield [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
        yield from rows.toJSON().toLocalIterator()
