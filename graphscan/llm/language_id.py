"""Operator 1: language identification by hyperdimensional profiles.

Every letter has a pseudo-random vector of +1 and -1 (a function of its code
point alone).  A letter n-gram is bound by permuting (rotating) its letters'
vectors by their places and multiplying them; a document is the bundle (sum)
of its n-gram vectors; a language's prototype is the bundle of its documents'
unit vectors.  What all languages share is removed by subtracting the mean
prototype from prototypes and documents; a document is given the language
whose prototype has the largest cosine, and a softmax of the cosines as score.

Letters are case-folded; runs of anything else are one boundary symbol.

Scale.  A prototype is fitted on about ``sample`` labelled documents of its
language, those with the smallest hashes of id and text (so a rare language
has all of its own); vectors are added up per language in Spark.  Every text
is then read once, without a shuffle.  N-grams are bound some thousands at a
time, so memory does not follow the number of different ones.  The model is a
vector per language.

Cases.  A null text, an empty one and one without letters are ``und`` with
score 0; with no labelled documents, or an empty table, every text is; ties go
to the first language by name; repeated documents each get their row, null
doc_ids too; texts of any length are used whole; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, code_points, map_arrow, mix64, persist, string_slices

DIMENSIONS = 1024
#: Documents and n-grams multiplied at once: bound the matrices.
ROWS, GRAMS = 128, 8192
#: Languages up to which their shares are sent to the scan.
LANGUAGES = 50_000
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Lower-case code point of every letter, 0 of all else."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low[0]) if len(low) == 1 else cp
        _FOLD = table
    return _FOLD


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = mix64(mix64(points.astype(np.uint64) + np.uint64(0x51ED27))[:, None] + np.arange(dimensions // 64, dtype=np.uint64)[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


class Profiler:
    """Bundles n-grams of documents into vectors."""

    def __init__(self, n: int = 3, dimensions: int = DIMENSIONS):
        self.n, self.dimensions = n, dimensions

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Document vectors of length 1 (0 without letters), and which documents have letters."""
        n = len(texts)
        out, has = np.zeros((n, self.dimensions), np.float32), np.zeros(n, bool)
        whole = " " + " ".join(texts) + " "
        cps = _fold()[code_points(whole)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        # a run of non-letters is one boundary symbol
        keep = np.ones(len(cps), bool)
        keep[1:] = (cps[1:] != 0) | (cps[:-1] != 0)
        at = np.flatnonzero(keep)
        symbols, points = self._compact(cps[at])
        doc = np.searchsorted(ends, at, "left")  # the boundary after a document still is its own
        doc = np.minimum(doc, n - 1)
        has[doc[symbols > 0]] = True
        k = len(points)
        m = len(symbols) - self.n + 1
        if m <= 0 or k == 1:
            return out, has
        code = symbols[:m].astype(np.int64)
        for j in range(1, self.n):
            code = code * k + symbols[j : j + m]
        # an n-gram belongs to the document of its middle letter and spans no other
        middle = self.n // 2
        owner = doc[middle : middle + m]
        real = symbols[middle : middle + m] > 0
        code, owner = code[real], owner[real]
        if k**self.n <= 1 << 22:
            used = np.flatnonzero(np.bincount(code, minlength=k**self.n))
            place = np.zeros(k**self.n, np.int32)
            place[used] = np.arange(len(used))
            gram = place[code]
        else:
            used, gram = np.unique(code, return_inverse=True)
        letters = letter_vectors(points, self.dimensions)
        letters[0] = np.abs(letters[0])  # the boundary symbol is neutral
        first = np.searchsorted(owner, np.arange(0, n + ROWS, ROWS))
        for g in range(0, len(used), GRAMS):
            some = used[g : g + GRAMS]
            bound = self._bound(some, letters, k)
            for b, lo in enumerate(range(0, n, ROWS)):
                hi = min(n, lo + ROWS)
                a, z = first[b], first[b + 1]
                row, column = owner[a:z] - lo, gram[a:z] - g
                if len(used) > GRAMS:
                    mine = (column >= 0) & (column < len(some))
                    row, column = row[mine], column[mine]
                if len(row):
                    counts = np.bincount(row * len(some) + column, minlength=(hi - lo) * len(some)).reshape(hi - lo, len(some))
                    # frequent n-grams would drown the rest in long texts
                    out[lo:hi] += np.sqrt(counts.astype(np.float32)) @ bound
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm), has

    def _bound(self, grams: np.ndarray, letters: np.ndarray, k: int) -> np.ndarray:
        """Vectors of n-grams: their letters' vectors, rotated by place and multiplied."""
        out, rest = np.ones((len(grams), self.dimensions), np.int8), grams.copy()
        for j in range(self.n - 1, -1, -1):
            out *= np.roll(letters, self.n - 1 - j, axis=1)[rest % k]
            rest //= k
        return out.astype(np.float32)

    @staticmethod
    def _compact(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        present = np.unique(folded[folded < 0x3000])
        wide = folded >= 0x3000
        points = np.unique(np.concatenate([[0], present, folded[wide]]))
        table = np.zeros(int(points[-1]) + 1, np.int32)
        table[points] = np.arange(len(points))
        return table[folded], points


def fit(documents: DataFrame, sample: int = 5_000, profiler: Profiler | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from (doc_id, text, lang), of about ``sample`` rows of each language."""
    profiler = profiler or Profiler()
    bounded_batches(documents.sparkSession)
    known = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    share = persist(known.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")), "languages")
    if share.count() <= LANGUAGES:  # some tens of bytes each; else the join is left to the planner
        share = F.broadcast(share)
    place = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    rows = known.join(share, "lang").where(place < F.col("share")).select("text", "lang")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, np.ndarray] = {}
        langs = np.array(batch.column(1).to_pylist(), object)
        for lo, hi, texts in string_slices(batch.column(0)):
            vectors, has = profiler.vectors(texts)
            for lang in set(langs[lo:hi]):
                mine = (langs[lo:hi] == lang) & has
                if mine.any():
                    sums[lang] = sums.get(lang, 0) + vectors[mine].sum(axis=0, dtype=np.float64)
        names = sorted(sums)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k].tolist() for k in names], pa.list_(pa.float64()))], ["lang", "total"])

    added = map_arrow(rows, work, "lang string, total array<double>").select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    total: dict[str, np.ndarray] = {}
    for row in added.collect():  # a vector per language
        total.setdefault(row.lang, np.zeros(profiler.dimensions))[row.i] = row.x
    names = sorted(total)
    if not names:
        return [], np.zeros((0, profiler.dimensions), np.float32)
    unit = np.stack([total[k] / max(np.linalg.norm(total[k]), 1e-12) for k in names])
    return names, unit.astype(np.float32)


def classify(vectors: np.ndarray, has: np.ndarray, names: list[str], unit: np.ndarray, sharpness: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: none) and score of document vectors."""
    if not len(names):
        return np.full(len(vectors), -1), np.zeros(len(vectors))
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(unit.shape[1], np.float32)
    centred = unit - mean
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    shifted = vectors - (vectors @ mean)[:, None] * mean / max(float(mean @ mean), 1e-12)
    cosine = shifted @ centred.T / np.maximum(np.linalg.norm(shifted, axis=1, keepdims=True), 1e-12)
    e = np.exp(sharpness * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64))
    best = cosine.argmax(axis=1)
    score = (e / e.sum(axis=1, keepdims=True))[np.arange(len(best)), best]
    return np.where(has, best, -1), np.where(has, score, 0.0)


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], profiler: Profiler | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    profiler = profiler or Profiler()
    bounded_batches(documents.sparkSession)
    names, unit = model

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        for _, _, texts in string_slices(batch.column(1)):
            best, score = classify(*profiler.vectors(texts), names, unit)
            langs += [names[i] if i >= 0 else "und" for i in best.tolist()]
            scores.append(score)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(documents.selectExpr("cast(doc_id as long) as doc_id", "text"), work, "doc_id long, lang_pred string, score double")
