"""Operator 7: quality classifier by regularised quadratic discriminant analysis.

* Statistics of a text (numpy over whole Arrow batches), transformed so that a
  class is nearly normal: logarithms of counts and of rates per word or character.
* Fit. Per class the mean and a shrunken covariance, (1 - a) S_k + a diag(S) with
  the pooled variances as target, from at most TRAIN labelled rows (a documented
  bound, chosen by a hash of the id). Its Cholesky factor and log determinant are
  computed once and broadcast (a few numbers).
* Score. Log density of a class is -(|L^-1 (x - m)|^2 + log det) / 2, the squared
  length being the Mahalanobis distance; the score is the posterior of class 1.

Rows: a null text is empty; empty texts have defined statistics and so a score.
A null id counts as the empty text for the fold. Rows that repeat an id are scored
one by one. Without labels of both classes every score is the share of class 1
(0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLD, HELD_OUT = 5, 0
TRAIN = 20_000
SHRINK = 0.1
THRESHOLD = 0.3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
            "shout": b"!?", "bar": b"|<>[]{}\\", "symbol": b"#$%&*+=@^~_/", "stop": b".,;:", "line": b"\n"}
FEATURES = ("words", "word_length", "upper", "digit", "shout", "bar", "symbol", "stop", "lines",
            "repeated_neighbours", "distinct_words", "repeated_lines")


def _counted(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[off])


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys per text."""
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    new = np.ones(k.size, bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def _line_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every non-empty line."""
    if not data.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = data != 10
    first = np.zeros(data.size + 1, bool)
    first[off] = True
    begin, last = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1] | first[1:-1]
    last[:-1] &= ~ink[1:] | first[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return C.word_hashes(data, s, e), np.searchsorted(off, s, "right") - 1


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed statistics, texts x FEATURES."""
    n = len(texts)
    data, off = C.buffer(texts)
    s, e, first = C.word_spans(data, off)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    h = C.word_hashes(data, s, e)
    chars = np.maximum(_counted((data & 0xC0) != 0x80, off), 1)
    w = np.maximum(words, 1)
    count = {}
    for k, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        count[k] = _counted(table[data], off)
    # an accented capital is the byte C3 and one of 80-9E
    accent = np.zeros(data.size, bool)
    if data.size:
        accent[1:] = (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
    upper = count["upper"] + _counted(accent, off)
    same = np.zeros(h.size, bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    lines, line_of = _line_hashes(data, off)
    n_lines = np.bincount(line_of, minlength=n)
    rate = lambda x, y: np.log(0.002 + x / y)
    return np.column_stack([
        np.log1p(words), np.log(np.bincount(of, e - s, n) / w + 1), rate(upper, chars), rate(count["digit"], chars),
        rate(count["shout"], w), rate(count["bar"], w), rate(count["symbol"], w), rate(count["stop"], w),
        np.log1p(n_lines) - np.log1p(words), rate(np.bincount(of, same, n), w), np.log(_distinct(h, of, n) / w + 0.01),
        rate(n_lines - _distinct(lines, line_of, n), np.maximum(n_lines, 1))])


class Discriminant:
    """Class means and cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = SHRINK):
        self.share = float(np.mean(y == 1)) if y.size else 0.5
        self.classes = []
        if np.unique(y).size < 2:
            return
        groups = [x[y == k] for k in (0, 1)]
        pooled = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / len(x)
        for g in groups:
            mean = g.mean(axis=0)
            cov = (g - mean).T @ (g - mean) / len(g)
            cov = (1 - shrink) * cov + np.diag(shrink * pooled + 1e-4)
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), len(g) / len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        logs = [np.log(p) - (((x - m) @ inv.T) ** 2).sum(axis=1) / 2 - det / 2 for m, inv, det, p in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch):
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN, shrink: float = SHRINK) -> Discriminant:
    C.prepared(docs.sparkSession)
    sample = C.labelled_sample(docs, labels, "quality", FOLD, HELD_OUT, train, "quality-sample")
    rows = sample.mapInArrow(_features, "label int, x array<double>").toPandas()      # at most ``train`` rows
    x = np.array(rows.x.tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)                                 # the same sums whatever the order of partitions
    return Discriminant(x[order], rows.label.to_numpy()[order], shrink)


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in C.slices(batch):
                s = model.score(statistics(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def classify(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    C.prepared(spark)
    d = C.pick(docs, doc_id="long", text="string").select(
        "doc_id", (C.crc_mod(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(_score(spark.sparkContext.broadcast(model), threshold),
                        "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op7_quality": op7_quality}
ORACLE = {}
