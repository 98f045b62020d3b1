"""Operator 7: n-gram Jaccard join with packed count-vector tree leaves.

A document's set holds its distinct ``n``-word shingles (its whole word
sequence, if it has fewer words).  Two documents link when
100 * |A & B| >= percent * |A | B|.

Method.
1. Each text becomes a sorted array of 64-bit shingle keys; texts with equal
   sets are one class with a count.
2. Blocking.  Keys are ordered rarest first, as estimated from words and
   shingles of a bounded sample (the order affects speed only).  Sets that
   link have many pairs of shared keys that follow each other in both sorted
   arrays (``signatures``); ``least_shared`` bounds their number by the size
   of a set.  Small groups under a signature give counted pairs; a group beyond
   ``GROUP`` gives edges to a hub, for members that are in enough such groups
   to reach that number but for two (in one group, if small or of a size that
   may share fewer with a small set).  Pairs that reach it with what they may
   share in large groups, and hubs, are joined into candidate components.
3. In a component, keys are hashed into 64 groups; the group counts of a set
   are its point.  Points are packed by size into leaves of at most 1024, each
   with its bounding box.  The overlap of two points is at most the sum over
   coordinates of the smaller count, that of two leaves the same sum of box
   maxima; leaf pairs and then point pairs under the needed overlap are left
   out, the rest verified on the sets themselves.
4. Links are counted per class (with the counts of equal sets) and joined
   into components by contraction.

A tree over all documents with no blocking gives the same links but cannot
prune: in any box over unrelated texts every group is filled, so each text
would meet every leaf of its size.  Hence step 2.

Scale.  Two passes over the texts.  Signatures leave a task as packed bytes,
at most ``GROUP`` + 1 of one signature, so a hot group sends a bounded number
per task.  Pairs go in rounds, so disk stays in proportion to the postings while
their number grows with the square of the documents'.  Components are range-partitioned into leaves, so one of any
size is spread; leaf pairs are a join.  No pair of a group is emitted before
its leaves were bounded, and links of a leaf leave it as sums and spanning
edges.

Cases.  Null, empty and wordless texts have 0 shingles, no links and are their
own component; repeated rows are documents of their own and link with each
other; null doc_ids count as documents, and a component of only such has a
null id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import LOWER, arrow_batches, byte_slices, hashed_rows, map_arrow, mix64, persist, span_hashes, true_runs

GROUPS = 64
LEAF_ROWS = 1024
LEAF_KEYS = 200_000
#: Linked pairs of large sets are expected to share so many kept signatures at least, ...
EXPECTED = 60.0
#: ... and share fewer than this with a probability under 1e-10.
LEAST = 18
#: ... taken from all but this percentage of their keys, the most frequent ones.
TAIL = 8
#: Shared signatures that make a pair a candidate (1 if either set is small).
SHARED = 3
#: Sets under one signature up to which it gives pairs; a larger group is joined by a hub.
GROUP = 128
#: Signatures that a task sends at once.
FLUSH = 1_000_000
#: Bytes of postings that a bucket holds before surplus members of large groups are passed on.
HELD_BYTES = 64 << 20
#: Postings of a bucket that are sorted at once.
SORTED = 500_000
#: Postings of small groups in a row between the two steps.
ROW_POSTINGS = 50_000
#: Bytes of pairs that a round may send in any case.
PAIR_BYTES = 1 << 30
#: Leaves on each side of a tile, the unit in which pairs of leaves are compared: the root of their number, within these bounds.
TILE, MOST_TILE = 8, 48
HUB = 1 << 50
#: Marks in a posting's byte beside the size class (modulo 64): see ``flags``.
SMALL, FEW = 128, 64

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_FACTORS = mix64(np.arange(900, 964, dtype=np.uint64)) | np.uint64(1)


class Ranks:
    """Sorted hashes with a rank; 0 for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, scale: float):
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], np.clip(scale * np.log2(np.maximum(counts[order], 2) / 2), 0, 255).astype(np.uint8)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint8)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(maybe):
            some = hashes[maybe]
            at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == some, self.ranks[at], 0)
        return out


class Shingles:
    """Turns texts into sorted key arrays, the supposedly rarest keys first.

    A key is 56 bits of hash under a rank of 8 bits: the larger of the ranks
    of the shingle itself and of its words together.
    """

    def __init__(self, n: int = 2, words: Ranks | None = None, grams: Ranks | None = None):
        self.n, self.words, self.grams = n, words, grams

    def keys(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of every shingle occurrence (document order) and where each document's begin."""
        data = LOWER[data]
        starts, ends = true_runs(_WORD[data])
        words = span_hashes(data, starts, ends)
        first = np.searchsorted(starts, offsets)
        counts = np.diff(first)
        m = len(words) - self.n + 1
        grams, rank = np.empty(0, np.uint64), np.empty(0, np.uint8)
        if m > 0:
            total = words[:m] * _FACTORS[0]
            for j in range(1, self.n):
                total += words[j : j + m] * _FACTORS[j]
            grams = mix64(total) >> np.uint64(8)
            rank = np.zeros(m, np.uint8)
            if self.words is not None:
                single = self.words.of(words).astype(np.int16)
                rank = np.minimum(sum(single[j : j + m] for j in range(self.n)), 255).astype(np.uint8)
                rank = np.maximum(rank, self.grams.of(grams))
            grams |= rank.astype(np.uint64) << np.uint64(56)
        sizes = np.where(counts >= self.n, counts - self.n + 1, (counts > 0).astype(np.int64))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        full = np.flatnonzero(counts >= self.n)
        out = np.empty(int(bounds[-1]), np.uint64)
        at = np.repeat(first[:-1][full] - bounds[:-1][full], sizes[full])
        place = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in full]) if len(full) and len(full) < len(counts) else np.arange(len(at))
        out[place] = grams[place + at]
        for i in np.flatnonzero((counts > 0) & (counts < self.n)):
            out[bounds[i]] = mix64(words[first[i] : first[i + 1]] * _FACTORS[self.n : self.n + counts[i]]).sum(dtype=np.uint64, keepdims=True)[0] >> np.uint64(8)
        return out, bounds

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct keys of each document."""
        keys, bounds = self.keys(data, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = np.sort(keys[a:b])
            if b - a > 1:
                fresh = np.empty(b - a, bool)
                fresh[0] = True
                np.not_equal(part[1:], part[:-1], out=fresh[1:])
                part = part[fresh]
            yield part


def digest(keys: np.ndarray) -> str:
    return hashlib.md5(keys.tobytes(), usedforsecurity=False).hexdigest()


def node_of(name: str) -> int:
    """48 bits of a digest: equal nodes of unequal sets only make a candidate component larger."""
    return int(name[:12], 16)


def tight_sizes(percent: int) -> dict[int, list[int]]:
    """Set size -> sizes of intersections that need no two shared keys in a row (see ``signatures``)."""
    out: dict[int, set[int]] = {}
    for union in range(2, -(-200 // (2 * percent - 100)) if percent > 50 else 2):
        for differ in range(1, union * (100 - percent) // 100 + 1):
            if union - 2 * differ < 2:
                for size in range(union - differ, union + 1):
                    out.setdefault(size, set()).add(union - differ)
    return {k: sorted(v) for k, v in out.items()}


def sure_shared(n: int, percent: int) -> float:
    """Signatures that a set of n keys shares at least with any that it links with, the tail left out."""
    return n * (2 * percent - 100 - TAIL) / 100 - 1


@functools.cache
def few_sizes(percent: int) -> frozenset[int]:
    """Sizes of sets that are sure of SHARED signatures among their like, yet not with every small set that they link with.

    Of the neighbouring keys that a small set takes signatures of, a key of its own parts two pairs, one of
    the other set one; the other's left-out tail reaches as far as it is longer than what the small set leaves out.
    """
    out: set[int] = set()
    if 2 * percent - 100 <= TAIL:
        return frozenset()  # all sets are small
    for n in itertools.takewhile(lambda n: sure_shared(n, percent) < SHARED, itertools.count(1)):
        head = min(n, (200 - 2 * percent) * n // 100 + 2)
        for m in range(n, n * 100 // percent + 1):
            both = needed(n + m, percent)
            if both <= n and sure_shared(m, percent) >= SHARED and head - 1 - 2 * (n - both) - (m - both) - max(0, TAIL * m // 100 - (n - head)) < SHARED:
                out.add(m)
    return frozenset(out)


def least_shared(n: int, percent: int, exact: bool = False) -> int:
    """Signatures that a set of n keys shares at least with any that it links with, where each one with a small set counts as SHARED.

    One less than ``sure_shared`` (equal 40-bit ends of two signatures count once), or
    than LEAST where a set may be so large that it keeps a share of its signatures;
    SHARED where the other may be small.
    """
    if percent <= 50 or sure_shared(-(-percent * n // 100), percent) < SHARED:
        return SHARED
    most = LEAST if sure_shared(100 * n // percent, percent) > EXPECTED and not exact else 200  # packed counts end at 255
    return max(SHARED, min(math.ceil(sure_shared(n, percent)), most) - 1)


def flags(n: int, percent: int) -> int:
    return SMALL if sure_shared(n, percent) < SHARED else FEW if n in few_sizes(percent) else 0


def signatures(keys: np.ndarray, percent: int, tight: dict[int, list[int]], exact: bool = False) -> np.ndarray:
    """Hashes of neighbouring keys, of which linked sets share some.

    Let u be the size of the union, in the order of keys, and d the number of
    its keys in one set only.  Linked sets have d <= (100 - percent) u / 100,
    so above 50 percent the u - d shared keys outnumber the d others, and at
    least u - 2 d - 1 times two shared keys follow each other with none
    between, in the union and so in either set.  Every two neighbouring keys
    give a signature.

    Large sets leave out their last ``TAIL`` percent (each key left out costs
    one such place at most) and keep of the rest, by hash, a share that leaves
    ``EXPECTED`` of the least possible number.  Two linked sets share fewer
    than ``LEAST`` of these with a probability under 1e-10 at the very threshold
    and in the worst order of keys; with ``exact`` all are kept, which leaves nothing
    to chance.  Smaller sets keep all; those too small to be sure
    of ``SHARED`` need one, which is among the first (2 - percent/50) n + 2 keys
    of either, and the smallest give one for each subset that can be the whole
    intersection.  Up to 50 percent every key of the usual prefix is one.
    """
    n = len(keys)
    if percent <= 50:
        return mix64(keys[: n + percent * -n // 100 + 1])
    sure = sure_shared(n, percent)
    head = keys[: n - TAIL * n // 100] if sure >= SHARED else keys[: (200 - 2 * percent) * n // 100 + 2]
    mixed = mix64(head)
    out = mix64(mixed[:-1] * _FACTORS[1] + mixed[1:])
    if sure > EXPECTED and not exact:
        return out[out < np.uint64(EXPECTED / sure * 2.0**64)]
    if n in tight:
        mixed = mix64(keys)
        sums = [sum(part) & (1 << 64) - 1 for size in tight[n] if math.comb(n, size) <= 1000 for part in itertools.combinations(mixed.tolist(), size)]
        singles = mix64(keys) if any(math.comb(n, size) > 1000 for size in tight[n]) else keys[:0]
        out = np.concatenate([out, mix64(np.array(sums, np.uint64)), singles])
    return out


def needed(total, percent: int):
    """Least overlap of two sets with ``total`` elements in sum: o >= percent (total - o) / 100."""
    return -(-percent * total // (100 + percent))


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that link lie in the same or in neighbouring classes."""
    step = -np.log(percent / 100 * (1 - 1e-9))
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / step), 127).astype(np.uint8)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value in a or b and the least value joined with it."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # follow pointers
            deeper = new[new]
            if np.array_equal(deeper, new):
                break
            new = deeper
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _grouped(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and node without repeats, and the start and size of each key's group."""
    order = np.lexsort((node, key))
    k, x = key[order], node[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    order, k = order[fresh], k[fresh]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(k)))


def _pairs(node: np.ndarray, size: np.ndarray, starts: np.ndarray, counts: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, shared signatures) of groups of 2 to GROUP nodes, where u is ``mine``; pairs with a small set count as SHARED."""
    names, ids = np.unique(node, return_inverse=True)
    small, class_ = size >= SMALL, (size & 63).astype(np.int16)
    pairs, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(counts[(counts > 1) & (counts <= GROUP)]).tolist():
        i, j = np.triu_indices(m, 1)
        at = starts[counts == m]
        for lo in range(0, len(at), max(1, 2_000_000 // len(i))):
            part = at[lo : lo + max(1, 2_000_000 // len(i)), None]
            a, b = (part + i).ravel(), (part + j).ravel()
            fits = ((class_[a] - class_[b] + 1) & 63 <= 2) & mine[a]
            a, b = a[fits], b[fits]
            found, back = np.unique(ids[a] * len(names) + ids[b], return_inverse=True)
            pairs.append(found)
            weights.append(np.bincount(back, np.where(small[a] | small[b], SHARED, 1), len(found)).astype(np.int64))
    found, back = np.unique(np.concatenate(pairs), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(found)).astype(np.int64)
    return names[found // max(len(names), 1)], names[found % max(len(names), 1)], weight


def frequent(documents: DataFrame, n: int, total: int, sample: int = 4_000, least: int = 3) -> tuple[Ranks, Ranks]:
    """Ranks of words and of shingles that occur at least ``least`` times in about ``sample`` of ``total`` texts (they affect speed only)."""
    texts = hashed_rows(documents.select("doc_id", "text").where("text is not null"), total, sample).select("text")
    maker = Shingles(n)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, words = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for _, _, data, offsets in byte_slices(batch.column(0)):
            grams += list(maker.sets(data, offsets))
            low = LOWER[data]
            words.append(span_hashes(low, *true_runs(_WORD[low])))
        found = [np.unique(np.concatenate(x), return_counts=True) for x in (words, grams)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [len(k) for k, _ in found]), pa.int32()), pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.concatenate([c for _, c in found]), pa.int64())], ["kind", "key", "n"]
        )

    rows = map_arrow(texts, work, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # bounded by the sample
    kind, key, count = (rows.column(i).to_numpy() for i in range(3))
    return tuple(Ranks(key[kind == k].view(np.uint64), count[kind == k].astype(np.float64), scale) for k, scale in ((0, 7.0), (1, 14.0)))


PASS_SCHEMA = "bucket int, kind int, u long, v long, name string, n long, packed binary"


def _rows(kind: int, u, v=None, name=None, n=None) -> pa.RecordBatch:
    k = len(u)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, kind), pa.int32()), pa.array(u, pa.int64()), pa.nulls(k, pa.int64()) if v is None else pa.array(v, pa.int64()), pa.nulls(k, pa.string()) if name is None else pa.array(name, pa.string()), pa.nulls(k, pa.int64()) if n is None else pa.array(n, pa.int64())],
        names=["kind", "u", "v", "name", "n"],
    )


def _to_bucket(rows: pa.RecordBatch, bucket: int | np.ndarray) -> pa.RecordBatch:
    k = rows.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(bucket, k), pa.int32()), *rows.columns, pa.nulls(k, pa.binary())], names=["bucket", *rows.schema.names, "packed"])


def _packed_rows(packed: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row (kind 1) for the records of each bucket."""
    order = np.argsort(bucket, kind="stable")
    packed = packed[order]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = [(i, packed[x:y].tobytes()) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
    k = len(used)
    yield pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in used], pa.int32()), pa.array(np.ones(k), pa.int32()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())), pa.array([x for _, x in used], pa.binary())],
        names=["bucket", "kind", "u", "v", "name", "n", "packed"],
    )


def _hubs(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return _rows(3, node, ((key >> np.uint64(24)).astype(np.int64) & ((1 << 40) - 1)) | HUB, None, np.where(size >= FEW, SHARED, 1))


def _first_pass(documents: DataFrame, shared, n: int, percent: int, buckets: int, exact: bool = False) -> DataFrame:
    """Rows of documents (kind 0: doc_id, text key, class, size), packed postings (kind 1) and members of large groups (kind 3)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, tight = Shingles(n, *shared.value), tight_sizes(percent)
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[str] = set()
        size = 0
        part = TaskContext.get().partitionId() % buckets
        for batch in batches:
            names, counts = [], []
            for _, _, data, offsets in byte_slices(batch.column(1)):
                for keys in maker.sets(data, offsets):
                    name = digest(keys)
                    names.append(name)
                    counts.append(len(keys))
                    if len(keys) and name not in seen:
                        seen.add(name)
                        signs = signatures(keys, percent, tight, exact)
                        held.append((signs, len(keys), node_of(name)))
                        size += len(signs)
                        if size >= FLUSH:
                            yield from flush(held, part)
                            held, seen, size = [], set(), 0
            yield _to_bucket(_rows(0, batch.column(0), batch.column(2), names, counts), part)
        if held:
            yield from flush(held, part)

    def flush(held, part) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p) for p, _, _ in held])
        whole = np.array([x for _, x, _ in held])
        flagged = size_class(whole, percent) & 63 | np.array([flags(x, percent) for x in whole.tolist()], np.uint8)
        key, sizes, node = np.concatenate([p for p, _, _ in held]), np.repeat(flagged, lengths), np.repeat(np.array([x for _, _, x in held], np.int64), lengths)
        order, starts, counts = _grouped(key, node)
        key, sizes, node = key[order], sizes[order], node[order]
        # the bucket sees from this that a group is large; who is not sent joins its hub from here
        beyond = np.arange(len(key)) - np.repeat(starts, counts) > GROUP
        if beyond.any():
            yield _to_bucket(_hubs(key[beyond], node[beyond], sizes[beyond]), part)
            key, sizes, node = key[~beyond], sizes[~beyond], node[~beyond]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        packed = np.empty((len(key), 12), np.uint8)
        packed[:, :5] = (key >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        packed[:, 5] = sizes
        packed[:, 6:] = node.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
        yield from _packed_rows(packed, bucket, buckets)

    return documents.selectExpr("cast(doc_id as long) as doc_id", "text", "xxhash64(text) as text_key").mapInArrow(run, PASS_SCHEMA)


def _number(part: np.ndarray) -> np.ndarray:
    """Little-endian numbers of at most 7 bytes, a row each."""
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, : part.shape[1]] = part
    return wide.view("<i8").ravel().copy()


def _postings(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of packed postings by key and node without repeats, keys and nodes (unordered), and the start and size of each key's group."""
    key, node = _number(packed[:, :5]).view(np.uint64), _number(packed[:, 6:12])
    return (order := _grouped(key, node))[0], key, node, order[1], order[2]


def _parts(packed: np.ndarray) -> Iterator[np.ndarray]:
    """Packed postings in parts of about ``SORTED`` at most, all of one key in one part.

    What sorting takes besides the postings themselves is thus bounded.  The lowest
    byte tells the parts: the highest is small where large sets keep a share of their signatures.
    """
    parts = 1
    while parts < 256 and len(packed) > parts * SORTED:
        parts *= 2
    if parts == 1:
        yield packed
        return
    at = packed[:, 0] & (parts - 1)
    for i in range(parts):
        yield packed[at == i]


def _unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    whole = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    blobs.clear()
    return whole


GROUPED_SCHEMA = "kind int, u long, v long, name string, n long, packed binary"


def _group_postings(first: DataFrame, partitions: int) -> DataFrame:
    """Rows of documents and large groups, and the postings of small groups with two sets at least (kind 1, n: pairs in them), whole groups to a row.

    Most signatures are of one set and end here.
    """

    def wide(rows: pa.RecordBatch, packed: list[bytes] | None = None) -> pa.RecordBatch:
        last = pa.nulls(rows.num_rows, pa.binary()) if packed is None else pa.array(packed, pa.binary())
        return pa.RecordBatch.from_arrays([*rows.columns, last], [*rows.schema.names, "packed"])

    def trimmed(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Surplus members of large groups among ``blobs``, as hub rows; at most GROUP + 1 of each signature stay."""
        kept = []
        for packed in _parts(_unpacked(blobs, 12)):
            order, key, node, starts, counts = _postings(packed)
            beyond = np.arange(len(order)) - np.repeat(starts, counts) > GROUP
            if beyond.any():
                out = order[beyond]
                yield wide(_hubs(key[out] << np.uint64(24), node[out], packed[out, 5]))
            kept.append(packed[order[~beyond]].tobytes())
        blobs.append(b"".join(kept))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        limit = HELD_BYTES
        for batch in batches:
            packed = batch.column(1).to_numpy() == 1
            if not packed.all():
                plain = batch.filter(pa.array(~packed))
                yield wide(pa.RecordBatch.from_arrays(plain.columns[1:6], ["kind", "u", "v", "name", "n"]))
            if packed.any():
                blobs.extend(batch.filter(pa.array(packed)).column(6).to_pylist())
            if sum(map(len, blobs)) > limit:
                yield from trimmed(blobs)
                limit = max(HELD_BYTES, 2 * len(blobs[0]))
        for packed in _parts(_unpacked(blobs, 12)):
            order, key, node, starts, counts = _postings(packed)
            out = order[np.repeat(counts > GROUP, counts)]
            if len(out):
                yield wide(_hubs(key[out] << np.uint64(24), node[out], packed[out, 5]))
            fits = (counts > 1) & (counts <= GROUP)
            packed, counts = packed[order[np.repeat(fits, counts)]], counts[fits]
            ends, pairs = np.cumsum(counts), counts * (counts - 1) // 2
            lo = 0
            while lo < len(counts):
                begin = int(ends[lo] - counts[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, begin + ROW_POSTINGS, "right")))
                yield wide(_rows(1, [None], n=[int(pairs[lo:hi].sum())]), [packed[begin : int(ends[hi - 1])].tobytes()])
                lo = hi

    return first.repartition(partitions, "bucket").mapInArrow(run, GROUPED_SCHEMA)


def _join_postings(first: DataFrame, partitions: int) -> DataFrame:
    """Rows of documents and large groups as they are, and candidate pairs (kind 2: u, v) that share enough signatures.

    Pairs of a group go on as packed (u, v, shared) to the bucket of u, where they are added up.
    Their number grows faster than the documents', so they go in rounds, each
    with the pairs of some u: what a round sends is bounded by ``PAIR_BYTES``, or twice the
    bytes of the postings it comes from, and removed before the next one.
    """
    grouped = persist(_group_postings(first, partitions), "jaccard-first")
    n_pairs, held = grouped.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("packed")), F.lit(0))).first()
    rounds = max(1, -(-13 * n_pairs // max(PAIR_BYTES, 2 * held)))
    out = grouped.where("kind <> 1").drop("packed")
    for at in range(rounds):
        out = out.unionByName(persist(_pair_sums(grouped.where("kind = 1").select("packed"), partitions, at, rounds), "jaccard-pairs"))
    return out


def _pair_sums(grouped: DataFrame, partitions: int, at: int, rounds: int) -> DataFrame:
    """Pairs (kind 2) that share at least SHARED signatures of ``grouped`` postings, of those u that fall to round ``at``."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = _unpacked(batch.column(0).to_pylist(), 12)
            order, _, node, starts, counts = _postings(packed)
            node, size = node[order], packed[order, 5]
            mixed = mix64(node.astype(np.uint64))
            u, v, shared = _pairs(node, size, starts, counts, (mixed >> np.uint64(32)) % np.uint64(rounds) == at)
            out = np.empty((len(u), 13), np.uint8)
            out[:, :6] = u.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
            out[:, 6:12] = v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
            out[:, 12] = np.minimum(shared, 255)
            for rows in _packed_rows(out, (mix64(u.astype(np.uint64)) % np.uint64(4 * partitions)).astype(np.int64), 4 * partitions):
                yield rows.select(["bucket", "packed"])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _unpacked([x for batch in batches for x in batch.column(1).to_pylist()], 13)
        u, v, shared = _number(packed[:, :6]), _number(packed[:, 6:12]), packed[:, 12]
        order = np.lexsort((v, u))
        u, v, shared = u[order], v[order], shared[order]
        starts = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))) if len(u) else np.empty(0, np.int64)
        if len(starts):
            sums = np.add.reduceat(shared.astype(np.int64), starts)
            enough = starts[sums >= SHARED]
            yield _rows(2, u[enough], v[enough], None, sums[sums >= SHARED])

    return grouped.mapInArrow(pairs, "bucket int, packed binary").repartition(partitions, "bucket").mapInArrow(add_up, "kind int, u long, v long, name string, n long")


def _candidates(joined: DataFrame, percent: int = 60, exact: bool = False) -> DataFrame:
    """Edges (u, v) between classes that may share as many signatures as they must, or with the hubs of large groups.

    A class that lies in m large groups shares at most m signatures there, the
    rest of ``least_shared`` in small groups.  So a pair that shares s in small
    groups links only if s and the smaller m reach the larger ``least_shared``; and a
    pair with s under SHARED needs a hub only if that leaves both m above ``least_shared`` - SHARED.
    """
    member = joined.where("kind = 3").select("u", "v", "n").distinct()
    node = F.conv(F.substring("name", 1, 12), 16, 10).cast("long")
    # sizes beyond the last entry need as many as it
    table = [least_shared(n, percent, exact) for n in range(5_000)]
    needs = F.element_at(F.lit(table), F.least(F.col("n"), F.lit(len(table) - 1)).cast("int") + 1)
    sizes = joined.where("kind = 0 and n > 0").groupBy(node.alias("node")).agg(F.min(needs).alias("needs"))
    hot = member.groupBy("u").agg(F.sum("n").alias("m")).withColumnRenamed("u", "node")
    state = persist(sizes.join(hot, "node", "left").select("node", "needs", F.coalesce("m", F.lit(0)).alias("m")), "jaccard-nodes")
    side = lambda x: state.toDF(x, f"{x}_needs", f"{x}_m")
    pairs = joined.where("kind = 2").select("u", "v", "n").join(side("u"), "u").join(side("v"), "v")
    pairs = pairs.where(F.col("n") + F.least("u_m", "v_m") >= F.greatest("u_needs", "v_needs")).select("u", "v")
    often = state.where(F.col("m") > F.col("needs") - SHARED).where(F.col("m") >= SHARED).select(F.col("node").alias("u"))
    return pairs.unionByName(member.select("u", "v").join(often, "u", "left_semi"))


#: Bits of the filter that spares most texts the shuffle of the second pass; its 8 MB do not grow.
FILTER_BITS = 1 << 26


def _likely(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``documents`` that may have one of the ids (doc_id), and all that have one."""
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select(place().alias("at")).selectExpr("bitmap_bucket_number(at) as part", "bitmap_bit_position(at) as bit").groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    placed = documents.withColumn("at", place()).selectExpr("*", "bitmap_bucket_number(at) as part", "bitmap_bit_position(at) as bit")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    near = placed.join(F.broadcast(bits), "part").withColumn("byte", byte).where(F.expr("shiftright(byte, cast(bit % 8 as int)) & 1") == 1)
    return near.select(*documents.columns)


def connected(edges: DataFrame, kind: str = "long") -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): the least node joined with it.

    Every round maps a node to its least neighbour and contracts the edges by
    that; components stay as they are and shrink until no edge is left.
    """
    spark = edges.sparkSession
    steps: list[DataFrame] = []
    left = persist(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = persist(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")).select(F.col("u").alias("node"), "to"), "labels")
        steps.append(step)
        mapped = left.join(step.select(F.col("node").alias("u"), F.col("to").alias("p")), "u").join(step.select(F.col("node").alias("v"), F.col("to").alias("q")), "v")
        left = persist(mapped.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "edges")
    if not steps:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    out = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        out = step.join(out.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out


# ------------------------------------------------------------------ leaves


class Leaf:
    """Some sets of one component: their points, box and keys."""

    def __init__(self, names: list[str], weights: list[int], sets: list[np.ndarray]):
        self.names, self.weights, self.sets = names, np.array(weights, np.int64), sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.points = self._points().astype(np.int32)
        self.box = self.points.max(axis=0)

    def _points(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self.sets)), self.sizes)
        group = (np.concatenate(self.sets) & np.uint64(GROUPS - 1)).astype(np.int64)
        return np.bincount(row * GROUPS + group, minlength=len(self.sets) * GROUPS).reshape(-1, GROUPS)

    def pack(self) -> bytes:
        return b"".join([len(self.sets).to_bytes(4, "little"), self.weights.astype("<i8").tobytes(), self.sizes.astype("<i8").tobytes(), "".join(self.names).encode(), np.concatenate(self.sets).astype("<u8").tobytes()])

    @staticmethod
    def unpack(data: bytes) -> Leaf:
        k = int.from_bytes(data[:4], "little")
        weights, sizes = np.frombuffer(data, "<i8", k, 4), np.frombuffer(data, "<i8", k, 4 + 8 * k)
        names = data[4 + 16 * k : 4 + 48 * k].decode()
        ends = np.cumsum(sizes)
        keys = np.frombuffer(data, "<u8", int(ends[-1]), 4 + 48 * k)
        return Leaf([names[32 * i : 32 * i + 32] for i in range(k)], weights.tolist(), [keys[e - s : e] for e, s in zip(ends, sizes)])


def _held_by(x: Leaf, y: Leaf) -> np.ndarray:
    """Keys of each set of x that some set of y has."""
    theirs = np.unique(np.concatenate(y.sets))
    flat = np.concatenate(x.sets)
    held = theirs[np.minimum(np.searchsorted(theirs, flat), len(theirs) - 1)] == flat
    return np.bincount(np.repeat(np.arange(len(x.sets)), x.sizes)[held], minlength=len(x.sets))


def leaf_links(x: Leaf, y: Leaf | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (index in x, index in y; in x itself if y is None), each once."""
    other = y or x
    need = needed(x.sizes[:, None] + other.sizes[None, :], percent)
    maybe = np.minimum(x.sizes[:, None], other.sizes[None, :]) >= need
    if y is None:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    if y is not None and maybe.any():
        # the points of sets beside one another overlap by chance; what a set shares is at most its keys that the other leaf has
        left, right = _held_by(x, other), _held_by(other, x)
        maybe &= np.minimum(left[:, None], right[None, :]) >= need
    i, j = np.nonzero(maybe)
    if len(i):
        bound = np.concatenate([np.minimum(x.points[i[a : a + 16384]], other.points[j[a : a + 16384]]).sum(axis=1) for a in range(0, len(i), 16384)])
        alive = bound >= need[i, j]
        i, j = i[alive], j[alive]
    if not len(i):
        return i, j
    if len(i) <= 8:
        overlap = np.array([len(np.intersect1d(x.sets[a], other.sets[b], assume_unique=True)) for a, b in zip(i, j)])
    else:
        left, right = np.unique(i), np.unique(j)
        total = _overlaps([x.sets[p] for p in left], [other.sets[p] for p in right], None if y else [x.sets[p] for p in np.union1d(left, right)])
        overlap = total[np.searchsorted(left, i), np.searchsorted(right, j)]
    good = overlap >= need[i, j]
    return i[good], j[good]


#: Keys whose 0/1 columns are multiplied at once.
COLUMNS = 2048


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], within: list[np.ndarray] | None) -> np.ndarray:
    """Shared keys of every set on the left with every one on the right, by products of 0/1 columns.

    ``within`` holds each set of either side once, if both are of one leaf.
    """
    if within is not None:
        flat, count = np.unique(np.concatenate(within), return_counts=True)
        common = flat[count > 1]  # what only one holds is never shared with another
    else:
        common = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        hit = np.flatnonzero(common[at] == flat) if len(common) else np.empty(0, np.int64)
        order = hit[np.argsort(at[hit], kind="stable")]
        return row[order], at[order]

    sides = [(places(s), len(s)) for s in (left, right)]
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), COLUMNS):
        parts = []
        for (row, at), k in sides:
            a, b = np.searchsorted(at, [lo, lo + COLUMNS])
            part = np.zeros((k, min(COLUMNS, len(common) - lo)), np.float32)
            part[row[a:b], at[a:b] - lo] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return np.rint(total).astype(np.int64)


def _report(x: Leaf, y: Leaf | None, percent: int, out: dict[str, list]) -> None:
    """Adds each class's links in these leaves, and spanning edges."""
    i, j = leaf_links(x, y, percent)
    if not len(i):
        return
    other = y or x
    sums_x = np.bincount(i, other.weights[j], len(x.names)).astype(np.int64)
    sums_y = np.bincount(j, x.weights[i], len(other.names)).astype(np.int64)
    if y is None:
        sums_x, sums_y = sums_x + sums_y, np.zeros(0, np.int64)
    ids = np.arange(len(x.names) + (len(y.names) if y else 0))
    nodes, low = roots(i, j + (len(x.names) if y else 0))
    names = x.names + (y.names if y else [])
    sums = np.concatenate([sums_x, sums_y])
    root = dict(zip(nodes.tolist(), low.tolist()))
    for p in ids[sums > 0].tolist():
        out["name"].append(names[p])
        out["links"].append(int(sums[p]))
        out["root"].append(names[root[p]])


LEAF_SCHEMA = "kind int, name string, links long, root string, comp long, leaf string, low long, high long, box array<int>, packed binary"


def _leaves(rows: DataFrame, shared, n: int, percent: int) -> DataFrame:
    """Leaves of components from rows (comp, size, name, weight, text) in order of component and size.

    Links within a leaf are reported at once (kind 0); a leaf is sent on
    (kind 1) if its component may have another one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(n, *shared.value)
        state = {"comp": None, "leaves": 0, "first": True}
        held: list[tuple[str, int, np.ndarray]] = []
        size, last = 0, None
        out = {"name": [], "links": [], "root": []}
        sent: list[tuple[int, Leaf]] = []

        def close(whole: bool) -> None:
            nonlocal held, size
            if held:
                leaf = Leaf(*(list(c) for c in zip(*held)))
                _report(leaf, None, percent, out)
                # alone in its component, and neither edge of the task's rows can hold more of it
                if not whole:
                    sent.append((state["comp"], leaf))
                state["leaves"] += 1
            held, size = [], 0

        for batch in batches:
            comps, names, weights = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, _, data, offsets in byte_slices(batch.column(3)):
                for at, keys in enumerate(maker.sets(data, offsets), lo):
                    if comps[at] != state["comp"]:
                        close(state["leaves"] == 0 and not state["first"])
                        state.update(comp=comps[at], leaves=0, first=state["comp"] is None)
                    if last == names[at] or digest(keys) != names[at]:
                        continue  # a repeated row, or another text under the same doc_id
                    if len(held) >= LEAF_ROWS or held and size + len(keys) > LEAF_KEYS:
                        close(False)
                    last = names[at]
                    held.append((last, weights[at], keys))
                    size += len(keys)
            yield from emit(out, sent)
        close(False)
        yield from emit(out, sent)

    def emit(out, sent) -> Iterator[pa.RecordBatch]:
        k, m = len(out["name"]), len(sent)
        if not k + m:
            return
        both = lambda kind, first, second: pa.concat_arrays([pa.array(first, kind) if first is not None else pa.nulls(k, kind), pa.array(second, kind) if second is not None else pa.nulls(m, kind)])
        yield pa.RecordBatch.from_arrays(
            [
                both(pa.int32(), [0] * k, [1] * m), both(pa.string(), out["name"], None), both(pa.int64(), out["links"], None), both(pa.string(), out["root"], None), both(pa.int64(), None, [c for c, _ in sent]),
                both(pa.string(), None, [x.names[0] for _, x in sent]), both(pa.int64(), None, [int(x.sizes.min()) for _, x in sent]), both(pa.int64(), None, [int(x.sizes.max()) for _, x in sent]),
                both(pa.list_(pa.int32()), None, [x.box.tolist() for _, x in sent]), both(pa.binary(), None, [x.pack() for _, x in sent]),
            ],
            names=["kind", "name", "links", "root", "comp", "leaf", "low", "high", "box", "packed"],
        )
        for c in out.values():
            c.clear()
        sent.clear()

    ordered = rows.select("comp", "size", "name", "weight", "text").repartitionByRange("comp", "size", "name").sortWithinPartitions("comp", "size", "name")
    return ordered.select("comp", "name", "weight", "text").mapInArrow(run, LEAF_SCHEMA)


def _across(leaves: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links between different leaves of a component.

    Leaves stand in order of size in tiles of at least ``TILE``, wider in large
    components; a leaf goes once to every pair of tiles that has a pair of leaves
    of its to compare, so it is copied by the root of their number.  Only the
    bounds of leaves (one row for some hundred sets) meet by component.
    """
    width = F.greatest(F.lit(TILE), F.least(F.lit(MOST_TILE), F.ceil(F.sqrt(F.count("*").over(W.partitionBy("comp"))))))
    box = leaves.select("comp", "leaf", "low", "high", "box", F.floor((F.row_number().over(W.partitionBy("comp").orderBy("low", "high", "leaf")) - 1) / width).alias("tile"))
    x, y = box.toDF("comp", "x", "x_low", "x_high", "x_box", "x_tile"), box.toDF("comp", "y", "y_low", "y_high", "y_box", "y_tile")
    ratio = lambda a, b: F.col(a) * 100 >= F.col(b) * percent
    fits = (F.col("x") < F.col("y")) & ratio("x_high", "y_low") & ratio("y_high", "x_low")
    overlap = F.aggregate(F.zip_with("x_box", "y_box", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, v: s + v)
    near = x.join(y, "comp").where(fits).where(overlap * (100 + percent) >= percent * (F.col("x_low") + F.col("y_low")))
    tile = F.struct("comp", F.least("x_tile", "y_tile").alias("a"), F.greatest("x_tile", "y_tile").alias("b")).alias("tile")
    sides = near.select(tile, F.explode(F.array(F.struct(F.col("x").alias("leaf"), F.col("y").alias("other")), F.struct(F.col("y").alias("leaf"), F.lit(None).cast("string").alias("other")))).alias("s"))
    sent = sides.groupBy("tile", "s.leaf").agg(F.collect_list("s.other").alias("others"))  # at most 2 x MOST_TILE
    rows = sent.join(leaves.select("leaf", "packed"), "leaf").select(F.concat_ws(" ", "tile.comp", "tile.a", "tile.b").alias("tile"), "leaf", "others", "packed")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for name, leaf, others, packed in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if name != tile:
                    yield from compared(held)
                    tile, held = name, {}
                held[leaf] = (Leaf.unpack(packed.as_py()), others)
        yield from compared(held)

    def compared(held: dict[str, tuple[Leaf, list[str]]]) -> Iterator[pa.RecordBatch]:
        out = {"name": [], "links": [], "root": []}
        for leaf, others in held.values():
            for other in others:
                _report(leaf, held[other][0], percent, out)
        if out["name"]:
            yield pa.RecordBatch.from_arrays([pa.array(out["name"], pa.string()), pa.array(out["links"], pa.int64()), pa.array(out["root"], pa.string())], ["name", "links", "root"])

    return rows.repartition(4 * partitions, "tile").sortWithinPartitions("tile").mapInArrow(work, "name string, links long, root string")


def jaccard_groups(documents: DataFrame, n: int = 2, percent: int = 60, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, the class ``name`` (digest of the set), its component's ``root`` class and ``text_key`` (xxhash64 of the text), per row.

    ``exact`` keeps every signature of large sets (about twice the shuffled bytes) instead of a hashed share.
    """
    with arrow_batches(documents.sparkSession, 8 << 20):
        return _groups(documents, n, percent, exact)


def _groups(documents: DataFrame, n: int, percent: int, exact: bool) -> DataFrame:
    spark = documents.sparkSession
    total = documents.count()
    shared = spark.sparkContext.broadcast(frequent(documents, n, total))  # bounded by the sample
    # a posting takes 12 bytes; its number follows that of the documents
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000 + 1)
    joined = _join_postings(_first_pass(documents, shared, n, percent, 4 * partitions, exact), partitions)
    rows = joined.where("kind = 0").select(F.col("u").alias("doc_id"), F.col("v").alias("text_key"), "name", "n")
    classes = rows.groupBy("name").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.first("n").alias("size"))
    comps = persist(connected(_candidates(joined, percent, exact)), "jaccard-candidates")
    node = F.conv(F.substring("name", 1, 12), 16, 10).cast("long")
    wanted = classes.where("size > 0").withColumn("node", node).join(comps, "node").select(F.col("root").alias("comp"), "name", "weight", "least", "size")
    wanted = persist(wanted, "jaccard-wanted")
    texts = _likely(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted.select(F.col("least").alias("doc_id"))).join(wanted, F.col("doc_id").eqNullSafe(F.col("least")))
    leaves = persist(_leaves(texts, shared, n, percent), "jaccard-leaves")
    links = leaves.where("kind = 0").select("name", "links", "root").unionByName(_across(leaves.where("kind = 1").select("comp", "leaf", "low", "high", "box", "packed"), percent, partitions))
    links = persist(links, "jaccard-links")
    groups = connected(links.select(F.col("name").alias("u"), F.col("root").alias("v")), "string")
    counts = links.groupBy("name").agg(F.sum("links").alias("links"))
    per_class = classes.join(counts, "name", "left").join(groups.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    lowest = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    found = persist(per_class.join(lowest, "root").select("name", "weight", F.coalesce("links", F.lit(0)).alias("links"), "component_id", "root"), "jaccard-classes")
    alone = F.col("n") == 0
    return rows.join(found, "name").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("weight") - 1 + F.col("links")).alias("n_similar"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "name", "root", "text_key",
    )


def drop_near_duplicates(documents: DataFrame, n: int = 2, percent: int = 60) -> DataFrame:
    """One row of each component, all columns as they were: that of the smallest doc_id (nulls last), then of the smallest text hash.

    Of rows that agree in both, one stays.  Rows without shingles (null, empty
    and wordless texts) are no group and stay.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    at, text = (names[documents.columns.index(c)] for c in ("doc_id", "text"))
    plain = documents.toDF(*names).withColumn("row_id", F.col(at).cast("long")).withColumn("row_key", F.xxhash64(text))
    groups = persist(jaccard_groups(documents, n, percent).where("n_shingles > 0").select("doc_id", "text_key", "root"), "jaccard-kept")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    # a row per kept document; the others are known by absence, and texts without shingles by having no group
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")).distinct()
    grouped = groups.groupBy(F.col("doc_id").alias("any_id"), F.col("text_key").alias("any_key")).agg(F.count("*").alias("n"))
    state = persist(
        grouped.join(kept, F.col("any_id").eqNullSafe(F.col("kept_id")) & (F.col("any_key") == F.col("kept_key")), "left").select("any_id", "any_key", "n", F.col("kept_key").isNotNull().alias("stays")), "jaccard-state"
    )
    found = plain.join(state.where("not stays").select("any_id", "any_key"), F.col("row_id").eqNullSafe(F.col("any_id")) & (F.col("row_key") == F.col("any_key")), "left_anti")
    repeated = state.where("stays and n > 1").select("any_id", "any_key")
    if repeated.isEmpty():
        return found.select(*names).toDF(*documents.columns)
    # rows of one id and text differ in other columns at most: any one of them stands for all
    same = F.col("row_id").eqNullSafe(F.col("any_id")) & (F.col("row_key") == F.col("any_key"))
    single = found.join(repeated, same, "left_anti").select(*names)
    twice = found.join(repeated, same, "left_semi")
    one = twice.groupBy(F.col("row_id"), F.col("row_key")).agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return single.unionByName(one).toDF(*documents.columns)
