"""Operator 4: quality by regularised quadratic discriminant analysis.

Statistics of each text (length, word lengths, shares of character kinds,
repetition of words and lines, sentence shape) are transformed by logarithms
towards normal shape.  Each class has a mean and a covariance shrunk towards
the pooled one and towards a multiple of the identity; its Cholesky factor is
kept.  The score is a logistic function (fitted on the same labelled rows) of
the difference of the classes' log densities: Mahalanobis terms by triangular
solves, and log determinants.

Scale.  The fit uses at most ``sample`` labelled documents (one row of each
id), of which the driver sees only the statistics (18 numbers each); every
text is read once, whole, without a shuffle, and the model is two means and
two factors.

Cases.  Null and empty texts have the statistics of an empty text and get a
score; with fewer than two labelled documents of a class the score is the rate
of label 1 (0 without labels); repeated rows each get theirs, null doc_ids
too; texts of any length are used whole; an empty table gives no rows; other
columns are ignored by ``score_quality`` and kept by ``keep_quality``,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import LOWER, WORD_BYTES, annotate, batch_with, bounded_batches, byte_slices, labelled_sample, map_arrow, span_hashes, true_runs

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 blank, 5 sentence mark, 6 other mark
_KIND[33:127] = 6
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:] = 3, 2, 1, 1
_KIND[[32, *range(9, 14)]] = 4
NAMES = ("bytes", "words", "word_size", "word_spread", "capitals", "digits", "blanks", "sentence_marks", "other_marks", "exclaims", "pipes", "distinct_words", "same_as_last", "lines", "distinct_lines", "short_words", "sentence_words", "marks_kinds")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of len(NAMES) transformed statistics for each document of a slice."""
    n = len(offsets) - 1
    firsts = offsets[:-1]
    size = np.diff(offsets) - 1
    total = np.maximum(size, 1).astype(np.float64)
    kind = _KIND[data]
    count = lambda mask: np.add.reduceat(mask, firsts, dtype=np.int64).astype(np.float64)
    letters, capitals, digits = count(kind == 1), count(kind == 2), count(kind == 3)
    blanks, marks, others = count(kind == 4) - 1, count(kind == 5), count(kind == 6)
    exclaims, pipes, newlines, stops = count(data == 33), count(data == 124), count(data == 10), count(data == 46)
    low = LOWER[data]
    starts, ends = true_runs(WORD_BYTES[data])
    doc = np.searchsorted(offsets, starts, "right") - 1
    length = (ends - starts).astype(np.float64)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    per = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    short = np.bincount(doc, length <= 3, n)
    hashes = span_hashes(low, starts, ends)
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    line = data != 10
    line[offsets[1:] - 1] = False
    a, b = true_runs(line)
    line_doc = np.searchsorted(offsets, a, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    logit = lambda x, of: np.log((x + 0.5) / (np.maximum(of - x, 0) + 0.5))
    return np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), logit(capitals, letters + capitals), logit(digits, total), logit(blanks, total), logit(marks, total), logit(others, total),
            np.log1p(1000 * exclaims / total), np.log1p(1000 * pipes / total), logit(_distinct(doc, hashes, n), words), logit(np.bincount(doc, same, n), words), np.log1p(newlines),
            logit(_distinct(line_doc, span_hashes(data, a, b), n), lines), logit(short, words), np.log1p(words / (stops + 1)), np.log1p(1000 * others / per),
        ],
        axis=1,
    )


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Different hashes in each document."""
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.float64)


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution y of factor @ y = right for a lower triangular factor."""
    out = np.empty_like(right)
    for i, row in enumerate(factor):
        out[i] = (right[i] - row[:i] @ out[:i]) / row[i]
    return out


class Discriminant:
    """Two shrunk Gaussians and a logistic calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = 0.1, ridge: float = 0.02, folds: int = 5):
        self.rate = float(y.mean()) if len(y) else 0.0
        self.ready = min((y == 0).sum(), (y == 1).sum()) >= 2
        if not self.ready:
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        self.parts = self._fit(z, y, pooled, ridge)
        margins = np.zeros(len(y))
        part = np.arange(len(y)) % folds
        for f in range(folds):  # calibrated on rows that the densities were not fitted on
            inner, outer = part != f, part == f
            fits = self._fit(z[inner], y[inner], pooled, ridge) if min(np.bincount(y[inner], minlength=2)) >= 2 else self.parts
            margins[outer] = self._margin(z[outer], fits)
        self.slope, self.offset = self._calibrate(margins, y)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    @staticmethod
    def _fit(z, y, pooled, ridge):
        within = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
        share = [(y == c).mean() for c in (0, 1)]
        both = share[0] * within[0] + share[1] * within[1]
        out = []
        for c in (0, 1):
            cov = (1 - pooled) * within[c] + pooled * both
            cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            out.append((z[y == c].mean(axis=0), factor, 2 * np.log(np.diag(factor)).sum()))
        return out

    @staticmethod
    def _margin(z, parts):
        density = [-0.5 * ((forward(factor, (z - mean).T) ** 2).sum(axis=0) + logdet) for mean, factor, logdet in parts]
        return np.arcsinh((density[1] - density[0]) / 4)  # outliers must not rule the calibration

    @staticmethod
    def _calibrate(m, y):
        a, b = 1.0, 0.0
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w, r = p * (1 - p) + 1e-9, p - goal
            hessian = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hessian, [(r * m).sum(), r.sum()])
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-8:
                break
        return a, b

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * self._margin(self._scaled(x), self.parts) + self.offset, -30, 30)))


def _statistics_of(column: pa.Array) -> np.ndarray:
    parts = [statistics(data, offsets) for _, _, data, offsets in byte_slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 20_000) -> Discriminant:
    bounded_batches(documents.sparkSession)
    rows = labelled_sample(documents, labels, target, sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _statistics_of(batch.column(0))
        return pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes() for r in found], pa.binary()), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int64())], ["x", "y", "doc_id"])

    got = map_arrow(rows.select("text", target, "doc_id"), work, "x binary, y int, doc_id long").collect()  # at most `sample` rows of 18 numbers
    got.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, "<f8") for r in got]).reshape(len(got), len(NAMES))
    return Discriminant(x, np.array([int(r.y > 0) for r in got], np.int64))


def score_quality(documents: DataFrame, model: Discriminant, least: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(_statistics_of(batch.column(1)))
        return batch_with(batch.select([0]), {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= least).astype(np.int32), pa.int32())})

    return map_arrow(documents.selectExpr("cast(doc_id as long) as doc_id", "text"), work, "doc_id long, score double, predicted int")


def keep_quality(documents: DataFrame, model: Discriminant, least: float = 0.7) -> DataFrame:
    """The rows of ``documents`` with a score of at least ``least``."""
    work = lambda texts: {"keep": pa.array(model.score(_statistics_of(texts)) >= least, pa.bool_())}
    return annotate(documents, "text", work, "keep boolean", keep=lambda made: made["keep"])
