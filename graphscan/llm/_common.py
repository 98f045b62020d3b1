"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches and are worked on as one long array of
UTF-8 bytes or code points per slice of documents, so that the per-document
cost in the interpreter stays small.  Slices are bounded in bytes, which keeps
a worker's memory flat however long single documents are.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a worker.
SLICE_BYTES = 2_000_000

_M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables that every executor can reach.

    It lies under ``spark.checkpoint.dir``.  A temporary folder stands in where
    the session has no such setting and all of it runs on one machine (tests);
    on a cluster that is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "graphscan-shared")
        os.makedirs(base, exist_ok=True)
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting lineage.

    The shuffles of that job are removed as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Limits the Arrow batches of jobs that run meanwhile."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch sent to a worker, where the session keeps Spark's own bound of 64 MB.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches, unless it is set to something else than Spark's own.

    It must hold when a returned DataFrame runs, so it stays lowered.
    """
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text form, modulo ``modulus`` (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an unsigned 64-bit array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_position_weights = np.empty(0, np.uint64)


def position_weights(n: int) -> np.ndarray:
    """Odd pseudo-random 64-bit weights for positions 0..n-1."""
    global _position_weights
    if len(_position_weights) < n:
        size = max(256, 1 << (int(n) - 1).bit_length())
        _position_weights = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _position_weights[:n]


_symbol_weights = mix64(np.arange(7, 263, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span symbols[start:end].

    ``symbols`` are bytes (uint8) or code points (uint32).
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    bounds = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int32) - np.repeat(bounds.astype(np.int32), lengths)
    picked = symbols[within + np.repeat(starts.astype(np.int32), lengths)]
    if symbols.dtype == np.uint8:
        value = _symbol_weights[picked]
    else:
        value = (picked.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
    value *= position_weights(int(lengths.max()))[within]
    value ^= value >> np.uint64(29)
    return mix64(np.add.reduceat(value, bounds) + lengths.astype(np.uint64))


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edge = np.concatenate(([0], edge))
    if mask[-1]:
        edge = np.concatenate((edge, [len(mask)]))
    return edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    bounds = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - bounds, lengths)


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of slices of a string column.

    The bytes hold one space after each document, so no word spans two of
    them; ``offsets[i]`` is where document i begins, the last entry where the
    slice ends.  A null is an empty text.
    """
    texts = column.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lengths = np.diff(raw)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), lengths, 0)
    size = np.cumsum(lengths + 1)
    lo = 0
    while lo < n:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + limit, "right")))
        part = lengths[lo:hi]
        offsets = np.concatenate(([0], np.cumsum(part + 1)))
        out = np.full(int(offsets[-1]), 32, np.uint8)
        for i, n_bytes in enumerate(part.tolist()):
            if n_bytes:
                begin = raw[lo + i]
                out[offsets[i] : offsets[i] + n_bytes] = data[begin : begin + n_bytes]
        yield lo, hi, out, offsets
        lo = hi


def string_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, last row, texts) of slices of a string column; null is empty."""
    lo, size, held = 0, 0, []
    for at in range(0, len(column), 256):
        for text in column.slice(at, 256).to_pylist():
            held.append(text or "")
            size += len(held[-1]) + 1
            if size >= limit:
                yield lo, lo + len(held), held
                lo, size, held = lo + len(held), 0, []
    if held:
        yield lo, lo + len(held), held


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size of ``df``: that of the files behind it, without reading them; 0 if it cannot tell."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    except AttributeError:  # no classic session
        return 0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceCache:
    """Ids of distinct pieces, found by 64-bit hash.

    When it is full, pieces that were met again since the last time stay and
    the rest go, so its memory is bounded by ``limit`` and one slice's pieces.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.hashes, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.pool, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.flag, self.used = np.empty(0, np.int8), np.empty(0, bool)

    def _shrink(self, room: int) -> None:
        keep = self.used if self.used.sum() + room <= self.limit else np.zeros(len(self.used), bool)
        new = (np.cumsum(keep) - 1).astype(np.int32)
        kept = keep[self.place]
        self.hashes, self.place = self.hashes[kept], new[self.place[kept]]
        self.pool = self.pool[ragged(self.begin[keep].astype(np.int64), self.size[keep])]
        self.size, self.flag = self.size[keep], self.flag[keep]
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.used = np.zeros(len(self.size), bool)

    def lookup(self, pieces: pa.Array, encode) -> np.ndarray:
        """Entry of each of the non-empty binary ``pieces``; ``encode`` gives (ids, sizes, flags) of a column of unseen ones."""
        if not len(pieces):
            return np.empty(0, np.int64)
        coded = pieces.dictionary_encode()
        names = coded.dictionary
        bounds = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
        hashes = span_hashes(np.frombuffer(names.buffers()[2], np.uint8), bounds[:-1], bounds[1:])
        if len(self.begin) + len(names) > self.limit:
            self._shrink(len(names))
        entry = np.full(len(names), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            entry[known] = self.place[at[known]]
            self.used[entry[known]] = True
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            ids, sizes, flags = encode(names.take(pa.array(fresh)))
            entry[fresh] = len(self.begin) + np.arange(len(fresh))
            self.begin = np.concatenate([self.begin, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.size = np.concatenate([self.size, sizes.astype(np.int32)])
            self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
            self.flag = np.concatenate([self.flag, flags.astype(np.int8)])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), bool)])
            order = fresh[np.argsort(hashes[fresh])]
            where = np.searchsorted(self.hashes, hashes[order])
            self.hashes = np.insert(self.hashes, where, hashes[order])
            self.place = np.insert(self.place, where, entry[order])
        return entry[coded.indices.to_numpy()]

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries in a row, and their number per entry."""
        counts = self.size[entries].astype(np.int64)
        return self.pool[ragged(self.begin[entries].astype(np.int64), counts)], counts


def pieces_of(whole: str, cps: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The pieces of a text between neighbouring ``edges`` (code points), as a binary column without copies."""
    data = whole.encode("utf-8", "surrogatepass")
    if len(data) != len(cps):
        size = np.ones(len(cps), np.int8)
        for least in (0x80, 0x800, 0x10000):
            size += cps >= least
        edges = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[edges]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


_kept: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """What ``make`` gave first for this key in this worker; later tasks of the worker find it again."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def library_threads(n: int = 2) -> None:
    """Threads of the tokenizers library in this worker, where the environment says nothing; to be called before its first use."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")


WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True


def hashed_rows(rows: DataFrame, total: int, bound: int, *key: str) -> DataFrame:
    """About ``bound`` of ``total`` rows, those with the smallest hashes of ``key`` (doc_id and text): a filter, without a shuffle.

    The same at any partitioning; all rows, if they are no more than ``bound``.
    Rows that agree in ``key`` are taken together, so callers aggregate them.
    """
    if total <= bound:
        return rows
    return rows.where(F.xxhash64(*(key or ("doc_id", "text"))) < int(-(2**63) + bound / total * 2.0**64))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(doc_id, text, target) of at most ``bound`` labelled documents, the first by a hash of their id.

    A filter by hash precedes the ranking of ids, so few go to one place; at
    most ``bound`` ids are sent to the scan of the documents, which bounds that
    broadcast.  Of labels that disagree the larger counts; of texts under one
    id that with the smallest hash, so that a repeated id gives one row.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias(target))
    near = hashed_rows(known, known.count(), bound + 8 * int(bound**0.5) + 8, "doc_id")
    chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("row"), F.max(target).alias(target))
    return texts.select("doc_id", "row.text", target)


def batch_with(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns and some more."""
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], [*batch.schema.names, *extra])


def annotate(documents: DataFrame, text: str, work: Callable[[pa.Array], dict[str, pa.Array]], schema: str, keep: Callable | None = None) -> DataFrame:
    """All columns of ``documents`` and those that ``work`` makes of the text column.

    With ``keep``, only rows for which it is true (given the new columns) stay,
    without the new columns.  Columns are taken by position, so clashing names do no harm.
    """
    at = documents.columns.index(text)
    width = len(documents.columns)
    plain = documents.toDF(*(f"c{i}" for i in range(width)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.column(at))
            yield batch.filter(keep(made)) if keep else batch_with(batch, made)

    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(documents.schema.fields)]
    names = documents.columns if keep else documents.columns + [x.split()[0] for x in schema.split(", ")]
    return plain.mapInArrow(run, ", ".join(kinds if keep else [*kinds, schema])).toDF(*names)
