"""Stored indexes and metadata tables: definition, writing, statistics and deletion.

An index table is a folder of Parquet files partitioned by index key, so one
index is deleted or replaced without touching the others.  Metadata tables
are DataFrames; their changes are given as plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shared_folder


class IndexStore:
    """Tables (``nodes``, ``edges`` or any other name) below one folder, each partitioned by ``key``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, table: str) -> bool:
        fs, path = self._path(table)
        return fs.exists(path)

    def ensure(self, table: str, schema: str) -> None:
        """An empty table, unless there is one."""
        if not self.exists(table):
            self.spark.createDataFrame([], schema).write.partitionBy("key").parquet(f"{self.folder}/{table}")
            self._describe(table, schema)

    def _describe(self, table: str, schema: str) -> None:
        self.spark.createDataFrame([(schema,)], "schema string").write.mode("overwrite").text(f"{self.folder}/_schema_{table}")

    def drop(self, table: str) -> None:
        for name in (table, f"_schema_{table}"):
            fs, path = self._path(name)
            fs.delete(path, True)

    def cycle(self, table: str, schema: str) -> None:
        """The table emptied, with a new schema."""
        self.drop(table)
        self.ensure(table, schema)

    def tables(self) -> list[str]:
        fs, path = self._path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().startswith("_")) if fs.exists(path) else []

    def read(self, table: str) -> DataFrame:
        schema = self.spark.read.text(f"{self.folder}/_schema_{table}").first()[0]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("key").parquet(f"{self.folder}/{table}")

    def upsert(self, table: str, rows: DataFrame, by: str = "id") -> None:
        """Rows replace those of the same key and ``by``; only the partitions they lie in are written anew.

        A row given twice counts once.  Readers see the old partitions until the new ones are complete.
        """
        old = self.read(table)
        fresh = rows.dropDuplicates(["key", by]).select(*old.columns)
        touched = old.join(fresh.select("key").distinct(), "key", "left_semi")
        merged = touched.join(fresh.select("key", by), ["key", by], "left_anti").select(*old.columns).unionByName(fresh)
        staged = shared_folder(self.spark, "upsert")
        merged.write.parquet(staged)
        self.spark.read.schema(old.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{self.folder}/{table}")
        fs, path = self.spark._jvm.org.apache.hadoop.fs.FileSystem, self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def delete_key(self, key: str, tables: tuple[str, ...] = ("nodes", "edges")) -> None:
        """One index leaves the tables: its partitions go, nothing is rewritten."""
        for table in tables:
            escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)
            fs, path = self._path(f"{table}/key={escaped}")
            fs.delete(path, True)

    def delete_where(self, table: str, condition: Column) -> None:
        """Rows that meet the condition leave; partitions without such rows stay as they are."""
        old = self.read(table)
        hit = old.where(condition).select("key").distinct()
        kept = old.join(hit, "key", "left_semi").where(~F.coalesce(condition, F.lit(False)))
        staged = shared_folder(self.spark, "delete")
        kept.write.parquet(staged)
        left = self.spark.read.schema(old.schema).parquet(staged)
        gone = hit.join(left.select("key").distinct(), "key", "left_anti").toLocalIterator()
        for row in list(gone):  # keys of indexes that lost all rows
            self.delete_key(row.key, (table,))
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{self.folder}/{table}")

    def stats(self) -> DataFrame:
        """table, key, rows and files of every index."""
        parts = [self.read(t).select("key", F.input_file_name().alias("_file")).groupBy("key").agg(F.count("*").alias("n_rows"), F.count_distinct("_file").alias("n_files")).select(F.lit(t).alias("table"), "key", "n_rows", "n_files") for t in self.tables()]
        out = parts[0] if parts else self.spark.createDataFrame([], "table string, key string, n_rows long, n_files long")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


# ---------------------------------------------------------------- metadata


def upserted(rows: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``rows`` with those of ``incoming`` in place of the ones they agree with in ``keys``; the last by ``order`` wins."""
    if order:
        incoming = incoming.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_place = 1").drop("_place")
    else:
        incoming = incoming.dropDuplicates(keys)
    return rows.join(incoming.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(incoming.select(*rows.columns))


def looked_up(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (one-, two- or three-column) key is wanted."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def updated(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``changes`` (one row per key) set where the key agrees."""
    fresh = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fresh], F.lit(True).alias("_hit"))
    joined = rows.join(marked, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in rows.columns])


def deleted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys), keys, "left_anti").select(*rows.columns)
