"""From parsed files to the nodes, edges and lookups of an index: one lazy plan.

files (key, repo, path, text, ast): ``ast`` is a syntax tree in JSON, given or
made by ``parsed``.  A file whose tree is missing, or cannot be read, gives an
error row and nothing else; the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linker import without_bad_edges
from ..sources.files import by_language
from ..sources.graph import PROPS, GraphSource
from . import javascript

EXTRACTORS = {"javascript": javascript.extract}

ROWS = pa.schema(
    [(n, pa.string()) for n in ("what", "key", "repo", "path", "id", "type", "name", "from", "to", "error")] + [(n, pa.int64()) for n in ("index", "start_index", "end_index", "start_line", "end_line")] + [("symbol", pa.bool_())]
)
SCHEMA = ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'long'}" for f in ROWS)


def parsed(files: DataFrame, parse: Callable[[str, str], str | None]) -> DataFrame:
    """``files`` with ``ast`` from a parser of (path, text); where it gives None or fails the file has no tree."""

    def tree(path: str, text: str) -> str | None:
        try:
            return parse(path, text)
        except Exception:  # a file that a parser rejects is skipped, and reported by ``extracted``
            return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tree(p, t) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "ast"])

    rows = files.drop("ast")
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "ast string"]))


def extracted(files: DataFrame) -> DataFrame:
    """Rows of nodes, edges, lookups and errors (``what``) of every file, per language it belongs to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in ROWS.names}

        def add(what: str, fields: tuple[str, ...], rows: list[tuple], **place: str) -> None:
            given = dict(zip(fields, zip(*rows)))
            for name, column in out.items():
                column.extend(given[name] if name in given else [what if name == "what" else place.get(name)] * len(rows))

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in ROWS], schema=ROWS)
            for column in out.values():
                column.clear()
            return batch

        for batch in batches:
            for key, repo, path, ast, language in zip(*(c.to_pylist() for c in batch.columns)):
                place = {"key": key, "repo": repo, "path": path}
                try:
                    if ast is None:
                        raise ValueError("no syntax tree")
                    found = EXTRACTORS[language](path, json.loads(ast))
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
                    add("error", ("error",), [(f"{type(e).__name__}: {e}",)], **place)
                    continue
                add("node", ("id", "type", "name", "index", "start_index", "end_index", "start_line", "end_line", "symbol"), found.nodes, **place)
                add("edge", ("type", "from", "to", "name", "index"), found.edges, **place)
                add("lookup", ("id", "index"), found.lookups, **place)
                if len(out["what"]) > 20_000:
                    yield made()
            if out["what"]:
                yield made()

    chosen = by_language(files).where(F.col("language").isin(*EXTRACTORS)).select("key", F.col("repo").cast("string").alias("repo"), "path", "ast", "language")
    rows = chosen.mapInArrow(run, SCHEMA)
    # ids are unique over indexes
    whole = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", "key", c)).alias(c)
    return rows.select(*[whole(c) if c in ("id", "from", "to") else F.col(f"`{c}`") for c in rows.columns])


def nodes(rows: DataFrame) -> DataFrame:
    named = F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    return rows.where("what = 'node'").select(
        "id", "type", "name", F.col("index").cast("int").alias("index"), named.alias("search_name"), F.array().cast(PROPS).alias("props"), "key", "path", "repo", "start_index", "end_index", "start_line", "end_line"
    )


def edges(rows: DataFrame) -> DataFrame:
    return without_bad_edges(rows.where("what = 'edge'").select("type", "from", "to", "name", F.col("index").cast("int").alias("index"), "key", "path"))


def symbols(rows: DataFrame) -> DataFrame:
    """What can be defined: path, start_index, end_index, node_id."""
    return rows.where("what = 'node' and symbol").select("path", "start_index", "end_index", F.col("id").alias("node_id"))


def lookups(rows: DataFrame) -> DataFrame:
    """Calls to be looked up: node_id, path, index (where the called name begins)."""
    return rows.where("what = 'lookup'").select(F.col("id").alias("node_id"), "path", "index")


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'error'").select("key", "path", "error")


def code_graph(rows: DataFrame, files: DataFrame | None = None) -> GraphSource:
    """The graph of extracted rows (written once by the caller, if it is read often)."""
    return GraphSource.of(nodes(rows), edges(rows), files.select("key", "path", "text") if files is not None else None)


def stored(rows: DataFrame, folder: str, files: DataFrame | None = None) -> GraphSource:
    """The graph of extracted rows, its nodes and different edges written once by type, so that a hop reads one type."""
    spark = rows.sparkSession
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    made, found = nodes(rows), edges(rows).dropDuplicates(["type", "from", "to", "name", "index"])
    made.write.partitionBy("type").parquet(f"{folder}/nodes")
    found.write.partitionBy("type").parquet(f"{folder}/edges")
    read = lambda df, name: spark.read.schema(df.schema).parquet(f"{folder}/{name}").select(*df.columns)
    return GraphSource({None: read(made, "nodes")}, {None: read(found, "edges")}, None, files, None, True)
