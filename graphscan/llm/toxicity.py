"""Operator 2: toxicity by nearest labelled examples.

Terms are words and word beginnings of four and five bytes (which hold what
made-up variants of a word share).  Documents and examples are TF-IDF vectors
of length 1 over every term of the representatives (below); a term that goes
with the label (chi-squared over all labelled rows) weighs more, by up to
``boost``.  The ``k`` nearest representatives by exact cosine vote, each with
weight 1 / (distance + ``soft``) and by the root of the number of labelled rows
under it; the share of toxic votes, smoothed by the overall rate, is made
a probability by a logistic function, fitted on the votes that every labelled
row gets from the others.

Index.  At most ``sample`` labelled documents, the first by a hash of their
ids, are representatives (all, if there are no more).  Every labelled row is
counted, with its label, under the representative nearest to it.  Frequencies
of terms and labels, the overall rate, the counts under representatives and
the logistic fit are over all labelled rows; only the choice of
representatives, and so of terms, is bounded.

Search.  Examples of equal text are one entry.  Alike entries come into one
tile (in which language they are decides most), cut into blocks of 64.  Every
term has a posting list; where it is long in a tile, it is kept as a row of
weights, which a matrix product sums faster than postings, with the largest
weight in each block.  What the other postings give is summed at once, since
they are not many more than their block maxima would be.  A query's bound on a block is
the largest of these sums in it, and its other weights times the block maxima;
the tile of the best block is opened first, then all others that have a block
whose bound reaches the k-th best cosine of that tile.  The result is exact
(to the rounding of 32-bit sums), ties going to the smaller entry.

Scale.  At most ``sample`` representatives are searched, so the index is some
MB at any size of corpus; every text is read whole, without a shuffle, and
labelled ones once more for the fit, as term counts of about a KB each.

Cases.  Null and empty texts, and those without any known term, have no
neighbours and get the calibrated score of the overall rate; no labelled
examples, or an empty table of labels: score 0; repeated rows each get
theirs; texts of any length are used whole; other columns are ignored by
``score_toxicity`` and kept by ``reject_toxic``, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, WORD_BYTES, annotate, batch_with, bounded_batches, byte_slices, labelled_sample, map_arrow, mix64, persist, ragged, span_hashes, true_runs
from .jaccard_join import _likely

BLOCK, DENSE = 64, 40
#: Most entries of a tile, and the terms by which alike entries come into one.
TILE, AXES = 16 * BLOCK, 256
#: Bytes of text, cosines, and postings worked on at once.
SLICE, STEP, SHORT_STEP = 1_000_000, 1_000_000, 400_000


def term_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term key) of every term occurrence in a slice."""
    data = LOWER[data]
    starts, ends = true_runs(WORD_BYTES[data])
    doc = np.searchsorted(offsets, starts, "right") - 1
    size = ends - starts
    docs, keys = [doc], [span_hashes(data, starts, ends)]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for n in (4, 5):
        mine = size > n
        at = starts[mine]
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | padded[at + j]
        docs.append(doc[mine])
        keys.append(mix64(code + np.uint64(0xABCDEF)))
    return np.concatenate(docs), np.concatenate(keys)


def counted(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs in order, and how often each occurs."""
    if not len(group):
        return group, value, np.empty(0, np.int64)
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1]))))
    return group[first], value[first], np.diff(np.append(first, len(group)))


class Space:
    """TF-IDF vectors over a sorted table of terms, each with its weight."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.__setstate__((keys[order], weights[order].astype(np.float32)))

    def __getstate__(self):
        return self.keys, self.weights

    def __setstate__(self, state):
        self.keys, self.weights = state
        # first[p]: how many keys begin with less than p; about one key in four beginnings
        self.shift = np.uint64(64 - max(1, min(24, (4 * len(self.keys)).bit_length())))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their terms."""
        if not len(self.keys) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        part = (keys >> self.shift).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        maybe = np.flatnonzero(at < end)
        at, end, keys = at[maybe], end[maybe], keys[maybe]
        hit = self.keys[at] == keys
        more = np.flatnonzero(~hit & (at + 1 < end))
        while len(more):  # keys of one beginning, one after the other
            at[more] += 1
            hit[more] = self.keys[at[more]] == keys[more]
            more = more[~hit[more] & (at[more] + 1 < end[more])]
        return maybe[hit], at[hit].astype(np.int64)

    def unit(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Weights of a sparse matrix whose rows have length 1."""
        weight = (1 + np.log(count)) * self.weights[term]
        norm = np.sqrt(np.bincount(doc, weight**2, n))
        return weight / np.where(norm == 0, 1, norm)[doc]

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of a slice, by document."""
        doc, term, count = self.counts(data, offsets)
        return doc, term, self.unit(doc, term, count, len(offsets) - 1)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of a slice, by document."""
        doc, key = term_keys(data, offsets)
        known, term = self.place(key)
        code, count = np.unique((doc[known].astype(np.int64) << 32) | term, return_counts=True)
        return code >> 32, code & 0xFFFFFFFF, count


def tiles_of(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of ``x`` in groups of at most ``most`` that are alike: halved along the axis on which they differ most."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        apart = x[rows] - x[rows].mean(axis=0)
        along = apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1]
        high = along > 0
        if not BLOCK <= high.sum() <= len(rows) - BLOCK:
            high = np.zeros(len(rows), bool)
            high[np.argsort(along, kind="stable")[len(rows) // 2 :]] = True
        open_ += [rows[high], rows[~high]]
    return out


class BlockMaxIndex:
    """Posting lists with block maxima: exact top-k by cosine among non-negative unit vectors."""

    def __init__(self, entry: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int):
        size = np.bincount(term, minlength=terms)
        often = np.argsort(-size, kind="stable")[:AXES]
        axis = np.full(terms, -1)
        axis[often] = np.arange(len(often))
        mine = axis[term] >= 0
        x = np.zeros((n, len(often)), np.float32)
        x[entry[mine], axis[term[mine]]] = 1
        x /= np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
        tiles = tiles_of(x, TILE)
        del x
        name = np.concatenate(tiles).astype(np.int64)
        place = np.empty(n, np.int64)
        place[name] = np.arange(n)
        place = place[entry]
        order = np.lexsort((place, term))
        #: Entries in the order of tiles, tiles' sizes, postings by term and place in that order: all that is sent to workers.
        self.kept = (n, name, np.array([len(t) for t in tiles]), size.astype(np.int32), place[order].astype(np.uint16 if n < 1 << 16 else np.int32), weight[order].astype(np.float32))
        self.n, self.opened, self.built = n, 0, False

    def __getstate__(self):
        return self.kept

    def __setstate__(self, kept):
        self.kept = kept
        self.n, self.opened, self.built = kept[0], 0, False

    def _build(self) -> None:
        """Rows of the long lists of each tile, with their block maxima; the postings of the others.  Where it is searched, not where it is only sent."""
        n, self.name, tile_size, size, place, weight = self.kept
        terms, tiles = len(size), len(tile_size)
        self.edge = np.concatenate(([0], np.cumsum(tile_size)))
        place, term = place.astype(np.int64), np.repeat(np.arange(terms), size)
        tile = np.repeat(np.arange(tiles), tile_size)[place]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tile[1:] != tile[:-1])))) if len(term) else np.empty(0, np.int64)
        length = np.diff(np.append(first, len(term)))  # of each term's list in each tile
        # a row costs as many steps as the tile has entries; a list its length, where the query has the term
        dense = np.repeat(length * size[term[first]] > tile_size[tile[first]] * (n / DENSE**2), length)
        long_ = np.zeros(terms, bool)
        long_[term[dense]] = True
        #: Row of each term with a long list in some tile, -1 for the others.
        self.row = np.where(long_, np.cumsum(long_) - 1, -1)
        starts = [np.arange(0, m, BLOCK) for m in tile_size]
        self.block_edge = np.concatenate(([0], np.cumsum([len(x) for x in starts])))
        self.blocks = int(self.block_edge[-1])
        self.most, self.rows, self.weights = np.zeros((int(long_.sum()), self.blocks), np.float32), [], []
        for t in range(tiles):
            mine = np.flatnonzero(dense & (tile == t))
            rows, at = np.unique(self.row[term[mine]], return_inverse=True)
            weights = np.zeros((len(rows), tile_size[t]), np.float32)
            weights[at, place[mine] - self.edge[t]] = weight[mine]
            self.most[rows, self.block_edge[t] : self.block_edge[t + 1]] = np.maximum.reduceat(weights, starts[t], axis=1)
            self.rows.append(rows)
            self.weights.append(weights)
        #: First entry of each block.
        self.block = np.concatenate([self.edge[t] + x for t, x in enumerate(starts)])
        self.place, self.weight = place[~dense], weight[~dense].astype(np.float64)
        self.list = np.concatenate(([0], np.cumsum(np.bincount(term[~dense], minlength=terms))))
        self.built = True

    def search(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and entries (-1: none) of the k nearest of each of m queries with a cosine above 0, nearest first."""
        best, who = np.zeros((m, k)), np.full((m, k), -1, np.int64)
        if not self.n or not len(doc):
            return best, who
        if not self.built:
            self._build()
        edges = np.searchsorted(doc, np.arange(m + 1))
        step = max(1, STEP // self.n)
        for lo in range(0, m, step):
            hi = min(m, lo + step)
            a, b = edges[lo], edges[hi]
            if b > a:
                best[lo:hi], who[lo:hi] = self._some(doc[a:b] - lo, term[a:b], weight[a:b], hi - lo, k)
        return best, who

    def _some(self, doc, term, weight, m, k):
        row = self.row[term]
        long_ = np.zeros((m, len(self.most)), np.float32)
        long_[doc[row >= 0], row[row >= 0]] = weight[row >= 0]
        cosine = self._short(doc, term, weight, m)
        bound = (long_ @ self.most + np.maximum.reduceat(cosine, self.block, axis=1)) * 1.0001  # rounding must not prune
        bound = np.maximum.reduceat(bound, self.block_edge[:-1], axis=1)
        first = np.zeros(bound.shape, bool)
        first[np.arange(m), bound.argmax(axis=1)] = True
        least = np.zeros(m, np.float32)  # no more than the k-th best cosine
        for t, mine in self._open(cosine, first, long_):
            if (size := int(self.edge[t + 1] - self.edge[t])) > k:
                least[mine] = np.partition(cosine[mine, self.edge[t] : self.edge[t + 1]], size - k, axis=1)[:, size - k]
        for _ in self._open(cosine, (bound >= least[:, None]) & (bound > 0) & ~first, long_):
            pass
        row, place = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
        value, entry = cosine[row, place], self.name[place]
        order = np.lexsort((entry, -value, row))
        row, entry, value = row[order], entry[order], value[order]
        at = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
        keep = at < k
        best, who = np.zeros((m, k)), np.full((m, k), -1, np.int64)
        best[row[keep], at[keep]], who[row[keep], at[keep]] = value[keep], entry[keep]
        return best, who

    def _short(self, doc, term, weight, m) -> np.ndarray:
        """What the postings outside of rows give to each query and entry."""
        out = np.zeros((m, self.n), np.float32)
        begin = self.list[term]
        sizes = self.list[term + 1] - begin
        some = np.flatnonzero(sizes)
        doc, begin, sizes, weight = doc[some], begin[some], sizes[some], weight[some].astype(np.float64)
        edges = np.searchsorted(doc, np.arange(m + 1))
        reach = np.concatenate(([0], np.cumsum(sizes)))[edges]
        lo = 0
        while lo < m:
            hi = min(m, max(lo + 1, int(np.searchsorted(reach, reach[lo] + SHORT_STEP, "right")) - 1))
            a, b = edges[lo], edges[hi]
            at = ragged(begin[a:b], sizes[a:b])
            to = self.place[at]
            to += np.repeat((doc[a:b] - lo) * self.n, sizes[a:b])
            value = self.weight[at]
            value *= np.repeat(weight[a:b], sizes[a:b])
            out[lo:hi] = np.bincount(to, value, (hi - lo) * self.n).reshape(hi - lo, self.n)
            lo = hi
        return out

    def _open(self, cosine, open_, long_):
        """Adds to ``cosine`` what the queries' long lists give in the opened tiles; gives each tile with its queries."""
        self.opened += int((open_ * np.diff(self.block_edge)).sum())
        for t in np.flatnonzero(open_.any(axis=0)):
            mine, rows = np.flatnonzero(open_[:, t]), self.rows[t]
            if len(rows):
                cosine[mine, self.edge[t] : self.edge[t + 1]] += long_[np.ix_(mine, rows)] @ self.weights[t]
            yield t, mine


class Model:
    def __init__(self, space: Space, index: BlockMaxIndex, toxic: np.ndarray, total: np.ndarray, examples: list[int], k: int, soft: float):
        self.space, self.index, self.toxic, self.total, self.examples, self.k, self.soft = space, index, toxic, total, examples, k, soft
        self.rate = float(toxic.sum() / total.sum()) if len(total) else 0.0
        self.slope, self.offset = 1.0, 0.0

    def votes(self, best: np.ndarray, who: np.ndarray, less: np.ndarray | int = 0, bad: np.ndarray | int = 0) -> np.ndarray:
        """Share of toxic votes, smoothed by the overall rate; ``less`` rows of each neighbour, ``bad`` of them toxic, do not count."""
        if not len(self.total):
            return np.zeros(len(who))
        total = self.total[who] - less
        weight = np.where(who >= 0, np.sqrt(total) / (1 - np.minimum(best, 1) + self.soft), 0)
        share = np.where(who >= 0, (self.toxic[who] - bad) / np.maximum(total, 1), 0)
        return ((weight * share).sum(axis=1) + self.rate) / (weight.sum(axis=1) + 1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        if not len(self.total):
            return np.zeros(len(votes))
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(votes) + self.offset, -30, 30)))

    def calibrate(self, votes: DataFrame) -> None:
        """Logistic fit of what all labelled rows are (bad) to the votes they get from the others (x: their logits), by Newton steps over sums."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("x") + b))))
            each = votes.select("x", (p * (1 - p) + 1e-9).alias("w"), (p - F.col("bad")).alias("r"))
            wxx, wx, w, rx, r = each.agg(F.sum(F.expr("w * x * x")), F.sum(F.expr("w * x")), F.sum("w"), F.sum(F.expr("r * x")), F.sum("r")).first()
            step = np.linalg.solve(np.array([[wxx + 1, wx], [wx, w]]), [rx + a - 1, r])  # a little pull towards the plain votes
            step *= min(1.0, 1 / abs(step).max()) if abs(step).max() else 1.0
            a, b = a - float(step[0]), b - float(step[1])
            if abs(step).max() < 1e-6:
                break
        if a > 0:
            self.slope, self.offset = a, b

    def near(self, data: np.ndarray, offsets: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        doc, term, weight = self.space.vectors(data, offsets)
        return self.index.search(doc, term, weight, len(offsets) - 1, k or self.k)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and entries and cosines of the neighbours, of a slice's documents."""
        best, who = self.near(data, offsets)
        return self.calibrated(self.votes(best, who)), who, best


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-6, 1 - 1e-6)
    return np.log(x / (1 - x))


def term_weights(n: int, n_bad: int, df: np.ndarray, toxic: np.ndarray, boost: float) -> np.ndarray:
    """Inverse document frequency of each term, times up to ``boost`` for one that goes with the label."""
    rate = n_bad / n
    expected = df * rate
    chi = np.where(toxic > expected, (toxic - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9), 0.0)
    return np.log(1 + n / df) * (1 + boost * np.clip((chi - 16) / 48, 0, 1))


def _labelled_vectors(documents: DataFrame, labels: DataFrame, target: str, names: np.ndarray) -> DataFrame:
    """(bad, terms, counts) of every labelled document, over the terms ``names``; texts take no shuffle."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("long").alias("bad"))
    known = persist(known, "toxicity-labels")
    shared = documents.sparkSession.sparkContext.broadcast(Space(names, np.ones(len(names))))  # the representatives' terms

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, counts = [], []
        for _, _, data, offsets in byte_slices(batch.column(2), SLICE):
            doc, term, count = shared.value.counts(data, offsets)
            edges = np.searchsorted(doc, np.arange(len(offsets)))
            terms += [term[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])]
            counts += [count[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "key", "terms", "counts"])

    texts = _likely(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known.select("doc_id"))
    found = map_arrow(texts.select("doc_id", F.xxhash64("text").alias("key"), "text"), work, "doc_id long, key long, terms binary, counts binary").join(known, "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct("key", "terms", "counts", "bad")).alias("row"))  # as in labelled_sample
    rows = persist(one.select("row.bad", "row.terms", "row.counts"), "toxicity-rows")
    shared.destroy()
    return rows


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of a batch of labelled vectors."""
    terms = batch.column(1).to_pylist()
    row = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
    return row, np.frombuffer(b"".join(terms), "<u4").astype(np.int64), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)


def _term_counts(held: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows, and toxic ones, that have each term."""

    def run(batches):
        df = np.zeros((2, terms), np.int64)
        for batch in batches:
            row, term, _ = _flat(batch)
            bad = batch.column(0).to_numpy() > 0
            df += [np.bincount(term, minlength=terms), np.bincount(term[bad[row]], minlength=terms)]
        some = np.flatnonzero(df[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[0, some]), pa.array(df[1, some])], ["term", "n", "bad"])

    got = held.mapInArrow(run, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow()  # a row per term of the representatives
    df, toxic = np.ones(terms, np.int64), np.zeros(terms, np.int64)
    at = got.column(0).to_numpy()
    df[at], toxic[at] = got.column(1).to_numpy(), got.column(2).to_numpy()
    return df, toxic


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = 3_000, k: int = 15, soft: float = 0.1, boost: float = 20.0) -> Model:
    """Index every labelled row under the nearest of at most ``sample`` representatives, and calibrate the votes on all rows."""
    bounded_batches(documents.sparkSession)
    rows = persist(labelled_sample(documents, labels, target, sample), "toxicity-examples")

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = [], []
        for _, _, data, offsets in byte_slices(batch.column(1), SLICE):
            doc, key, count = counted(*term_keys(data, offsets))
            edges = np.searchsorted(doc, np.arange(len(offsets)))
            keys += [key[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            counts += [count[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), batch.column(2).cast(pa.int64())], ["doc_id", "keys", "counts", "bad"])

    found = map_arrow(rows.select("doc_id", "text", target), sparse, "doc_id long, keys binary, counts binary, bad long").collect()  # at most `sample` sparse vectors
    alike: dict[bytes, list[int]] = {}
    parts: list[tuple[bytes, bytes]] = []
    for r in sorted(found, key=lambda r: r.doc_id):
        name = hashlib.sha256(len(r["keys"]).to_bytes(8, "little") + r["keys"] + r.counts).digest()
        if name not in alike:
            alike[name] = [r.doc_id, 0, 0]
            parts.append((r["keys"], r.counts))
        alike[name][1] += 1
        alike[name][2] += int(r.bad > 0)
    del found
    entries = list(alike.values())
    if not entries:
        none = np.empty(0, np.int64)
        return Model(Space(none.astype(np.uint64), np.empty(0)), BlockMaxIndex(none, none, np.empty(0), 0, 0), none, none, [], k, soft)
    example, total, toxic = (np.array([e[i] for e in entries], np.int64) for i in range(3))
    flat, counts = np.frombuffer(b"".join(p[0] for p in parts), np.uint64), np.frombuffer(b"".join(p[1] for p in parts), "<u4").astype(np.int64)
    sizes = np.array([len(p[0]) // 8 for p in parts], np.int64)
    del parts
    names, term = np.unique(flat, return_inverse=True)
    entry = np.repeat(np.arange(len(entries)), sizes)
    bad = (2 * toxic > total).astype(np.float64)
    held = _labelled_vectors(documents, labels, target, names)
    n, n_bad = held.agg(F.count("*"), F.count(F.when(F.col("bad") > 0, 1))).first()
    space = Space(names, term_weights(n, n_bad, *_term_counts(held, len(names)), boost))
    weight = space.unit(entry, term, counts, len(entries))
    # entries whose heaviest term is the same stand side by side, which makes block maxima tight
    top = np.full(len(entries), -1, np.int64)
    by = np.lexsort((weight, entry))
    top[entry[by]] = term[by]
    order = np.lexsort((example, top, -bad))
    place = np.empty(len(entries), np.int64)
    place[order] = np.arange(len(entries))
    index = BlockMaxIndex(place[entry], term, weight, len(entries), len(names))
    model = Model(space, index, toxic[order], total[order], example[order].tolist(), k, soft)
    model.rate = n_bad / n
    del flat, counts, term, entry, weight  # before the model is packed
    _count_lists(held, model)
    return model


def _count_lists(held: DataFrame, model: Model) -> None:
    """Counts each labelled row under its nearest representative, and calibrates the votes that rows get from the others."""
    shared = _shared(held, model)
    width = model.k + 1

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, rows = shared.value, batch.num_rows
        row, term, count = _flat(batch)
        best, who = m.index.search(row, term, m.space.unit(row, term, count, rows), rows, width)
        first = np.where(who[:, 0] >= 0, who[:, 0], -1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(first), pa.array([x.tobytes() for x in who.astype("<i4")], pa.binary()), pa.array([x.tobytes() for x in best.astype("<f8")], pa.binary())], ["bad", "first", "who", "best"]
        )

    found = persist(map_arrow(held, near, "bad long, first long, who binary, best binary"), "toxicity-near")
    shared.destroy()
    lists = found.where("first >= 0").groupBy("first").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad") > 0, 1)).alias("bad")).collect()  # a row per representative
    model.total, model.toxic = np.zeros(len(model.examples), np.int64), np.zeros(len(model.examples), np.int64)
    for r in lists:
        model.total[r["first"]], model.toxic[r["first"]] = r.n, r.bad
    votes_of = Model(Space(np.empty(0, np.uint64), np.empty(0)), None, model.toxic, model.total, [], model.k, model.soft)  # without the index
    votes_of.rate = model.rate

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        who = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(rows, width).astype(np.int64)
        best = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<f8").reshape(rows, width).copy()
        bad = (batch.column(0).to_numpy() > 0).astype(np.int64)
        less = np.zeros(who.shape, np.int64)
        less[:, 0] = who[:, 0] >= 0  # its own list counts without it
        same = (who[:, 0] >= 0) & (best[:, 0] > 1 - 1e-6)  # equal texts are one
        drop = np.zeros(who.shape, bool)
        drop[np.arange(rows), np.where(same, 0, width - 1)] = True
        pick = lambda x: x[~drop].reshape(rows, width - 1)
        x = _logit(votes_of.votes(pick(best), pick(who), pick(less), pick(less * bad[:, None])))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(bad)], ["x", "bad"])

    model.calibrate(persist(map_arrow(found, others, "x double, bad long"), "toxicity-votes"))


def _shared(documents: DataFrame, model: Model):
    return documents.sparkSession.sparkContext.broadcast(model)  # the postings of at most `sample` examples


def score_toxicity(documents: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """doc_id, score, predicted and (with ``evidence``) the nearest examples' doc_ids and cosines."""
    bounded_batches(documents.sparkSession)
    shared = _shared(documents, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, scores, who, cos, sizes = shared.value, [], [], [], []
        names = np.array(model.examples, np.int64)
        for _, _, data, offsets in byte_slices(batch.column(1), SLICE):
            score, near, cosines = model.score(data, offsets)
            scores.append(score)
            if evidence:
                some = near >= 0
                sizes.append(some.sum(axis=1))
                who.append(names[near[some]])
                cos.append(cosines[some])
        score = np.concatenate(scores) if scores else np.empty(0)
        made = {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32), pa.int32())}
        if evidence:
            at = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else [])))).cast(pa.int32())
            made |= {
                "examples": pa.ListArray.from_arrays(at, pa.array(np.concatenate(who) if who else [], pa.int64())),
                "cosines": pa.ListArray.from_arrays(at, pa.array(np.concatenate(cos) if cos else [], pa.float64())),
            }
        return batch_with(batch.select([0]), made)

    schema = "doc_id long, score double, predicted int" + ", examples array<long>, cosines array<double>" * evidence
    return map_arrow(documents.selectExpr("cast(doc_id as long) as doc_id", "text"), work, schema)


def reject_toxic(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score below ``least``, all columns as they were."""
    bounded_batches(documents.sparkSession)
    shared = _shared(documents, model)

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        scores = [shared.value.score(data, offsets)[0] for _, _, data, offsets in byte_slices(texts, SLICE)]
        return {"keep": pa.array((np.concatenate(scores) if scores else np.empty(0)) < least, pa.bool_())}

    return annotate(documents, "text", work, "keep boolean", keep=lambda made: made["keep"])
