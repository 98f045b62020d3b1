"""Operator 5: benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item; an item with
fewer words (but not none) is one window.  Words of a document inside any
occurrence of a window are hit.

Method.  Every run of ``k`` words is hashed, and of each ``window - k + 1``
neighbouring hashes the smallest is kept (winnowing).  A shared span of
``window`` words holds a whole neighbourhood, so both sides keep the same hash
in it: joining the kept hashes finds every shared window.  Each joined hash is
then extended to the windows that hold it, which are looked up among the
item's and compared word by word; neighbouring windows become one span.
Items too short for a neighbourhood are looked up by the hash of their whole
word sequence, and verified likewise.

Scale.  The fingerprints of one benchmark shard go to the workers; a shard's
text is bounded by ``shard_bytes`` (measured before it is gathered).  With one
shard, documents are read once and not shuffled.  A larger benchmark takes
several shards: each reads the documents once and keeps what it hits, under a
digest of the text, and only (id, words, digest) rows meet these hits.  Of an
item, a joined hash leads to at most ``window - k + 1`` windows to compare, so
the work is linear in a text's words also where words repeat.

Cases.  Null or wordless texts have no words and no hits; wordless items never
hit; repeated item ids or texts count as one item id; repeated documents and
null doc_ids are each reported; texts of any length are used whole; extra
columns are ignored by ``decontaminate`` and kept by ``drop_contaminated``,
whatever their names; an empty benchmark hits nothing; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, annotate, bounded_batches, byte_slices, map_arrow, mix64, persist, span_hashes, true_runs

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_ranges array<int>, items array<string>"

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True

_FACTORS = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def _gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _FACTORS[0]
    for j in range(1, k):
        total += words[j : j + n] * _FACTORS[j % 64]
    return mix64(total)


def _winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some w neighbouring hashes."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.arange(len(grams))
    low = grams[:n].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + n], out=low)
    keep = np.zeros(len(grams), bool)
    for j in range(w):
        keep[j : j + n] |= grams[j : j + n] == low
    return np.flatnonzero(keep)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, ASCII letters lowered."""
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(*(x.tolist() for x in true_runs(_WORD[data])))]


class BenchmarkIndex:
    """Fingerprints of benchmark items, small enough for one worker."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10, k: int = 7):
        self.window, self.k, self.w = window, k, window - k + 1
        self.items: list[tuple[str, list[bytes]]] = []
        self.long: dict[int, list[int]] = defaultdict(list)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, words in sorted({(str(i), tuple(words_of(t))) for i, t in items if i is not None}):
            if not words:
                continue
            number = len(self.items)
            self.items.append((name, list(words)))
            ends = np.cumsum([len(x) for x in words])
            data = np.frombuffer(b"".join(words), np.uint8)
            hashes = span_hashes(data, np.concatenate(([0], ends[:-1])), ends)
            if len(words) < window:
                self.short[len(words)][int(_gram_hashes(hashes, len(words))[0])].append(number)
                continue
            grams = _gram_hashes(hashes, k)
            for gram in np.unique(grams[_winnow(grams, self.w)]).tolist():
                self.long[gram].append(number)
        self.long, self.short = dict(self.long), {n: dict(x) for n, x in self.short.items()}
        self.filters = {0: self._filter(self.long)} | {n: self._filter(x) for n, x in self.short.items()}

    @staticmethod
    def _filter(keys) -> tuple[np.ndarray, np.ndarray]:
        ordered = np.sort(np.fromiter(keys, np.uint64, len(keys)))
        bits = np.zeros(1 << 20, bool)
        bits[(ordered >> np.uint64(44)).astype(np.int64)] = True
        return ordered, bits

    @staticmethod
    def _found(grams: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        ordered, bits = known
        if not len(ordered) or not len(grams):
            return np.empty(0, np.int64)
        at = np.flatnonzero(bits[(grams >> np.uint64(44)).astype(np.int64)])
        where = np.minimum(np.searchsorted(ordered, grams[at]), len(ordered) - 1)
        return at[ordered[where] == grams[at]]

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(document, words, hit ranges, item names) for each document of a slice."""
        data = LOWER[data]
        starts, ends = true_runs(_WORD[data])
        first = np.searchsorted(starts, offsets)
        hashes = span_hashes(data, starts, ends)
        sought: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        grams = _gram_hashes(hashes, self.k)
        kept = _winnow(grams, self.w)
        for at in kept[self._found(grams[kept], self.filters[0])].tolist():
            sought[int(np.searchsorted(first, at, "right")) - 1].append((0, at, int(grams[at])))
        for n in self.short:
            grams = _gram_hashes(hashes, n)
            for at in self._found(grams, self.filters[n]).tolist():
                sought[int(np.searchsorted(first, at, "right")) - 1].append((n, at, int(grams[at])))
        counts = np.diff(first)
        for doc in range(len(offsets) - 1):
            ranges, names = [], set()
            if doc in sought:
                lo, hi = int(first[doc]), int(first[doc + 1])
                raw = data[offsets[doc] : offsets[doc + 1]].tobytes()
                base = int(offsets[doc])
                words = [raw[a - base : b - base] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                ranges, names = self._verify(words, hashes[lo:hi], [(n, at - lo, h) for n, at, h in sought[doc]])
            yield doc, int(counts[doc]), ranges, names

    def _windows_of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of an item's windows, and where each first occurs."""
        if number not in self.windows:
            words = self.items[number][1]
            ends = np.cumsum([len(x) for x in words])
            hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])), ends)
            self.windows[number] = np.unique(_gram_hashes(hashes, self.window), return_index=True)
        return self.windows[number]

    def _verify(self, words: list[bytes], hashes: np.ndarray, found: list[tuple[int, int, int]]):
        spans, names, near = [], set(), defaultdict(set)
        for n, at, gram in found:
            if n:
                same = {self.items[i][0] for i in self.short[n][gram] if self.items[i][1] == words[at : at + n]}
                if same:
                    spans.append((at, at + n))
                    names |= same
                continue
            windows = range(max(0, at - self.w + 1), min(at, len(words) - self.window) + 1)
            for number in self.long[gram]:
                near[number].update(windows)
        whole = _gram_hashes(hashes, self.window)
        for number, starts in near.items():
            if not starts:
                continue
            name, item = self.items[number]
            known, first = self._windows_of(number)
            at = np.array(sorted(starts), np.int64)
            where = np.minimum(np.searchsorted(known, whole[at]), len(known) - 1)
            for i, p in zip(at[known[where] == whole[at]].tolist(), first[where[known[where] == whole[at]]].tolist()):
                if words[i : i + self.window] == item[p : p + self.window]:
                    spans.append((i, i + self.window))
                    names.add(name)
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _report(ids, n_words, ranges, names) -> pa.RecordBatch:
    ordered = [sorted(x) for x in names]
    n_hit = [sum(b - a for a, b in r) for r in ranges]
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ordered], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()),
            pa.array([[int(v) for span in r for v in span] for r in ranges], pa.list_(pa.int32())), pa.array(ordered, pa.list_(pa.string())),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_ranges", "items"],
    )


def _scan_shard(documents: DataFrame, items: list[tuple[str, str | None]], window: int, k: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)
    built: list[BenchmarkIndex] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(BenchmarkIndex(shared.value, window, k))
        n_words, ranges, names = [], [], []
        for _, _, data, offsets in byte_slices(batch.column(1)):
            for _, n, spans, found in built[0].scan(data, offsets):
                n_words.append(n)
                ranges.append(spans)
                names.append(found)
        return _report(batch.column(0), n_words, ranges, names)

    return map_arrow(documents, work, SCHEMA)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 7, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: words, words hit, items found, hit word ranges.

    ``hit_ranges`` lists start and end (exclusive) word numbers in turn.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.length("item_id")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    if shards == 1:
        return _scan_shard(docs, [tuple(r) for r in items.collect()], window, k)
    shards *= 2  # filled by hash of the item to half the bound, on average
    keyed = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = None
    for shard in range(shards):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()]
        if part:
            rows = persist(_scan_keyed(keyed, part, window, k).where("n_hit > 0").dropDuplicates(["key"]), "decontaminate")
            found = rows if found is None else found.unionByName(rows)
    return _merge_shards(keyed, found)


def _scan_keyed(texts: DataFrame, items, window: int, k: int) -> DataFrame:
    """As _scan_shard for rows (key, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(items)
    built: list[BenchmarkIndex] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(BenchmarkIndex(shared.value, window, k))
        ranges, names = [], []
        for _, _, data, offsets in byte_slices(batch.column(1)):
            for _, _, spans, found in built[0].scan(data, offsets):
                ranges.append([int(v) for span in spans for v in span])
                names.append(sorted(found))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(r) for r in ranges], pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
            ["key", "n_hit", "hit_ranges", "items"],
        )

    return map_arrow(texts.select("key", "text"), work, "key string, n_hit long, hit_ranges array<int>, items array<string>")


def _merge_shards(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Hits of all shards, merged per distinct text and put beside every document."""
    per_text = found.groupBy("key").agg(F.collect_list("hit_ranges").alias("parts"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("found"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words = []
        for _, _, data, offsets in byte_slices(batch.column(1)):
            starts, _ = true_runs(_WORD[LOWER[data]])
            n_words.extend(np.diff(np.searchsorted(starts, offsets)).tolist())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), batch.column(2)], ["doc_id", "n_words", "key"])

    joined = map_arrow(docs.select("doc_id", "text", "key"), count, "doc_id long, n_words long, key string").join(per_text, "key", "left").select("doc_id", "n_words", "parts", "found")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ranges = [merged([(r[i], r[i + 1]) for r in p or [] for i in range(0, len(r), 2)]) for p in parts]
        return _report(batch.column(0), batch.column(1).to_pylist(), ranges, [set(x or []) for x in names])

    return map_arrow(joined, work, SCHEMA)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 7, shard_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``documents`` without a word inside any benchmark window; all columns as they were."""
    bounded_batches(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.length("item_id")), F.lit(0))).first()[0]
    shards = 2 * -(-size // shard_bytes) if size > shard_bytes else 1
    for shard in range(shards):
        documents = _drop_shard(documents, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()], window, k)
    return documents


def _drop_shard(documents: DataFrame, items, window: int, k: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)
    built: list[BenchmarkIndex] = []

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        if not built:
            built.append(BenchmarkIndex(shared.value, window, k))
        return {"keep": pa.array([not ranges for _, _, data, offsets in byte_slices(texts) for _, _, ranges, _ in built[0].scan(data, offsets)], pa.bool_())}

    return annotate(documents, "text", work, "keep boolean", keep=lambda made: made["keep"])
