"""Operator 6: exact top-k by inner product with Fagin's threshold algorithm.

Components x become floor(scale * x), integers.  For every dimension the
candidates of a block are kept sorted; a query walks each list from its good
end (the largest values for a positive weight, the smallest for a negative
one), scores what it meets for the first time in full, and stops when the
bound - the sum over dimensions of weight times the value last met - is below
the k-th best score.  Walks go by doubling depths, so that every step is a few
array operations.

Scale.  A query set against all rows, in blocks: queries are written once to
the shared folder in row groups; each task sorts one partition of candidates
and streams the queries past it, so neither side is ever whole in a task and
nothing is broadcast.  Its k + 1 best per query meet by query in one small
shuffle.

Cases.  Rows whose id or vector is null, or that hold a null or non-finite
component, take no part; a floor(scale * x) beyond 64 bits counts as the
largest or smallest 64-bit integer, and so does a score, summed exactly
before (scores cut so tie); rows with such sums are scored one by one in whole
numbers of any size; missing components of shorter vectors count as 0; a
query's own row is left out once, so equal rows of the same id still see one
another; ties go to the smaller id; fewer candidates give fewer rows; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import shared_dir

#: Candidates sorted together.
BLOCK_ROWS = 200_000


class SortedLists:
    """Per-dimension sorted lists of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # the smaller id is the earlier row
        self.ids, self.rows = ids[order], np.ascontiguousarray(vectors[order])
        self.n, self.d = self.rows.shape
        self.lists = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32).copy()
        self.values = np.take_along_axis(self.rows, self.lists.T.astype(np.int64), axis=0).T.copy()
        self.largest = float(np.abs(self.rows.astype(np.float64)).max(initial=0))

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        dims = np.flatnonzero(query)
        k = min(k, self.n)
        if not len(dims):
            return self.ids[:k], np.zeros(k, np.int64)
        if float(np.abs(query.astype(np.float64)).max()) * self.largest * len(dims) >= 2.0**62:
            return self._big(query, k)
        weights = query[dims]
        up = weights > 0
        seen = np.zeros(self.n, bool)
        best_rows, best = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, 16
        while depth < self.n:
            deeper = min(self.n, depth + step)
            met = np.concatenate([self.lists[dims[up], self.n - deeper : self.n - depth].ravel(), self.lists[dims[~up], depth:deeper].ravel()])
            mark = np.zeros(self.n, bool)
            mark[met] = True
            mark &= ~seen
            seen |= mark
            fresh = np.flatnonzero(mark)
            scores = self.rows[fresh] @ query
            rows, scores = np.concatenate([best_rows, fresh]), np.concatenate([best, scores])
            if len(rows) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= cut
                rows, scores = rows[near], scores[near]
            pick = np.lexsort((rows, -scores))[:k]
            best_rows, best = rows[pick], scores[pick]
            depth, step = deeper, step * 2
            last = np.where(up, self.values[dims, self.n - depth], self.values[dims, depth - 1])
            # at an equal bound an unseen row of a smaller id could still come in
            if len(best) == k and int(weights @ last) < best[-1]:
                break
        self.walked = depth
        return self.ids[best_rows], best

    def _big(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``top`` for numbers that 64 bits may not hold: exact sums, cut to what the column can show."""
        scores = [max(LEAST, min(MOST, int(x))) for x in self.rows.astype(object) @ query.astype(object)]
        pick = sorted(range(self.n), key=lambda i: (-scores[i], i))[:k]
        return self.ids[pick], np.array([scores[i] for i in pick], np.int64)


LEAST, MOST = -(2**63), 2**63 - 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on the columns ``vec_id`` and ``v``."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    )
    # a cast from double cannot fail between these bounds, the largest and smallest doubles within 64 bits
    whole_number = lambda x: F.when(x >= 9.2233720368547748e18, F.lit(MOST)).when(x <= -9.2233720368547748e18, F.lit(LEAST)).otherwise(F.floor(x))
    whole = clean.select("vec_id", F.transform("v", lambda x: whole_number(x.cast("double") * scale)).alias("v"))
    path = shared_dir(spark, "queries")
    whole.where(is_query).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v").write.parquet(path)
    queries = spark.read.schema("q long, vec_id long, v array<long>").parquet(path)
    width = max(whole.agg(F.max(F.size("v"))).first()[0] or 0, 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from block(held)
                held, n = [], 0
        if n:
            yield from block(held)

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        lists = SortedLists(rows.column(0).to_numpy(), _matrix(rows.column(1), width))
        fs, local = pafs.FileSystem.from_uri(path)
        for part in ds.dataset(local, filesystem=fs, format="parquet").to_batches(columns=["q", "vec_id", "v"], batch_size=1024):
            if not part.num_rows:
                continue
            found = [lists.top(v, k + 1) for v in _matrix(part.column(2), width)]
            counts = [len(x[0]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part.column(0).to_numpy(), counts)), pa.array(np.repeat(part.column(1).to_numpy(), counts)),
                    pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found])),
                ],
                ["q", "query_id", "vec_id", "score"],
            )

    near = whole.mapInArrow(run, "q long, query_id long, vec_id long, score long")
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: F.coalesce(F.try_add(a, F.try_multiply(x.cast("decimal(19,0)"), x.cast("decimal(19,0)"))).cast("decimal(38,0)"), F.lit(MOST).cast("decimal(38,0)")))
    own = queries.select("q", F.col("vec_id").alias("query_id"), F.least(square, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("own"))
    order = [F.desc("score"), F.asc("vec_id")]
    first = near.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("place") <= k + 1)
    # the query's own row is among the k + 1 best or beaten by k + 1 others
    marked = first.join(own.select("q", "own"), "q").withColumn("self", ((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))).cast("int"))
    nth_self = F.sum("self").over(W.partitionBy("q").orderBy(*order, "place").rowsBetween(W.unboundedPreceding, 0))
    others = marked.withColumn("nth", nth_self).where(~((F.col("self") == 1) & (F.col("nth") == 1)))
    ranked = others.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order, "place")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
