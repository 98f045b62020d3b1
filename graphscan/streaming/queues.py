"""Idempotent and bucketed queues, progress and index appends on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_per_key(items: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The batch form of an idempotent queue with no acknowledgement: the first item of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order, tie))
    return items.withColumn("_place", place).where("_place = 1").drop("_place")


def idempotent_queue(items: DataFrame) -> DataFrame:
    """Streams (key string, op string 'put' | 'ack', payload string): emits a put whose key is not in flight; an ack frees it."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        busy = bool(state.get[0]) if state.exists else False
        out = []
        for batch in batches:
            for row in batch.itertuples():
                if row.op == "ack":
                    busy = False
                elif not busy:
                    busy = True
                    out.append((key[0], row.payload))
        if busy:
            state.update((True,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "payload"])

    return items.groupBy("key").applyInPandasWithState(step, "key string, payload string", "busy boolean", "append", GroupStateTimeout.NoTimeout)


def next_per_bucket(items: DataFrame, working: DataFrame, bucket: str, priority: str, tie: str) -> DataFrame:
    """The most urgent item of every bucket, without those already worked on (``id``)."""
    free = items.join(working.select("id"), "id", "left_anti")
    place = F.row_number().over(W.partitionBy(bucket).orderBy(F.desc(priority), tie))
    return free.withColumn("_place", place).where("_place = 1").drop("_place")


def running_progress(rows: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """How many of its group have passed, and the share."""
    w = W.partitionBy(group)
    return rows.withColumn("done", F.count("*").over(w.orderBy(order, tie).rowsBetween(W.unboundedPreceding, 0))).withColumn("share", F.col("done") / F.count("*").over(w))


def append_index(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of nodes or edges to a table partitioned by index key; a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "key").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_queue(stream: DataFrame, working: str, path: str, checkpoint: str, bucket: str, priority: str, tie: str):
    """On every batch pops the most urgent waiting item of each bucket that has none in work.

    The stream holds (op 'put' | 'done', id, and the columns named).  ``working``
    is a folder of items, with ``state`` 'waiting' or 'working', one version a
    batch; ``path`` gets the popped ones.  A replayed batch writes the same again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put = batch.where("op = 'put'").drop("op").dropDuplicates(["id"]).withColumn("state", F.lit("waiting"))
        before = spark.read.schema(put.schema).parquet(f"{working}/{number - 1}") if number else put.where("false")
        done = batch.where("op = 'done'").select("id")
        held = before.unionByName(put.join(before.select("id"), "id", "left_anti").select(*put.columns)).join(done, "id", "left_anti").select(*put.columns)
        busy = held.where("state = 'working'").select(bucket).distinct()
        free = held.where("state = 'waiting'").join(busy, bucket, "left_anti")
        place = F.row_number().over(W.partitionBy(bucket).orderBy(F.desc(priority), tie))
        popped = free.withColumn("_place", place).where("_place = 1").select("id", F.lit(True).alias("_popped"))
        after = held.join(popped, "id", "left").withColumn("state", F.when(F.col("_popped"), "working").otherwise(F.col("state"))).withColumn("_now", F.coalesce("_popped", F.lit(False)))
        after.drop("_popped", "_now").select(*put.columns).write.mode("overwrite").parquet(f"{working}/{number}")
        after.where("_now").select(*[c for c in put.columns if c != "state"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_items(stream: DataFrame, work, path: str, checkpoint: str):
    """Applies ``work`` (an item's text to a text) to every item (id, payload) of a stream.

    An item that fails is recorded with its error and acknowledged all the
    same; the others go on.  Concurrency is that of Spark's tasks; stopping the
    query stops the queue.
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for payload in batch["payload"]:
                try:
                    results.append(work(payload))
                    errors.append(None)
                except Exception as e:  # whatever an item's work raises is that item's result
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"id": batch["id"], "result": results, "error": errors})

    def step(batch: DataFrame, number: int) -> None:
        batch.select("id", "payload").mapInPandas(one, "id string, result string, error string").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Appends the first row that comes of each key to a table; its state is one entry a key."""
    return stream.dropDuplicates(keys).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
