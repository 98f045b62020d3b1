"""Files as tables: contents, listings, trees and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages and the file endings that belong to them; a file may belong to several.
LANGUAGES = {"javascript": (".js", ".jsx", ".ts", ".tsx"), "ruby": (".rb",)}


def read_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = ()) -> DataFrame:
    """path (below ``folder``), text and size of every file below it, with one of the endings if any are given."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split(":", 1)[-1].rstrip("/").lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), "^" + base.replace(".", "\\.") + "/+", "")
    out = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"))
    return out.where(ends_with(F.col("path"), endings)) if endings else out


def ends_with(path: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | path.endswith(e)
    return out


def by_language(files: DataFrame) -> DataFrame:
    """A row per file and language it belongs to."""
    named = F.array_compact(F.array(*[F.when(ends_with(F.col("path"), ends), F.lit(name)) for name, ends in LANGUAGES.items()]))
    return files.withColumn("language", F.explode(named))


def listing(files: DataFrame) -> DataFrame:
    """Directory entries of flat paths: parent, name, whether a directory, files below (or 1)."""
    steps = files.select(F.split("path", "/").alias("s")).select("s", F.posexplode("s").alias("i", "name"))
    entry = steps.select(F.array_join(F.slice("s", F.lit(1), F.col("i")), "/").alias("parent"), "name", (F.col("i") < F.size("s") - 1).alias("is_dir"))
    return entry.groupBy("parent", "name").agg(F.max("is_dir").alias("is_dir"), F.count("*").alias("n"))


def in_listing_order(entries: DataFrame) -> DataFrame:
    """Directories first, then files, each by path."""
    return entries.orderBy("parent", F.desc("is_dir"), "name")


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (add, delete, modify) between two trees of (path, blob)."""
    both = before.select("path", F.col("blob").alias("_a")).join(after.select("path", F.col("blob").alias("_b")), "path", "full")
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "modify")
    return both.select("path", change.alias("change")).where("change is not null")


def snapshot_plan(changes: DataFrame | None, dirty: DataFrame | None, tree: DataFrame) -> DataFrame:
    """path and action (copy, delete) that turn a clone into a snapshot.

    With neither a diff index nor unsaved changes every file of ``tree`` is
    copied; a diff copies what it adds or modifies and deletes the rest of it;
    unsaved changes (path, change) lie over either.
    """
    if changes is None:
        base = tree.select("path", F.lit("copy").alias("action"))
    else:
        base = changes.select("path", F.when(F.col("change") == "delete", "delete").otherwise("copy").alias("action"))
    if dirty is None:
        return base.distinct()
    over = dirty.select("path", F.when(F.col("change") == "delete", "delete").otherwise("copy").alias("action")).distinct()
    return base.join(over.select("path"), "path", "left_anti").unionByName(over).distinct()


def summary(files: DataFrame, by: list[str]) -> DataFrame:
    """Files, directories and bytes of each group (a repository, a branch, an index)."""
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.count_distinct(F.regexp_replace("path", "/?[^/]*$", "")).alias("n_dirs"), F.sum("size").alias("bytes"))
