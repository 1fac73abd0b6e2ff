"""k-nearest-neighbour joins (V1 exact, V2 cell probing, V3 LSH).

Inputs are ``queries(qid, vec)`` and ``corpus(cid, vec)``; output is
``(qid, cid, score, rank)`` with ``rank`` 1..k ordered by the metric (smaller
squared L2 first; larger cosine / dot first) and then by ``cid``. Rows with a
null vector take no part; the cosine with a zero vector is 0; an empty side
gives an empty result.

Plans, chosen by the caller's arguments and never by a counted size:

* ``small="queries"`` / ``small="corpus"``: that side is declared small (at most
  ``SMALL`` rows, an error beyond). It is shipped once and the other side is
  scored batch by batch where it lies: its vectors are never shuffled. With
  small queries a task emits k rows per query; with a small corpus the rank is
  final in the task.
* both sides large, exact: a block join. Rows are dealt to blocks of about
  ``BLOCK`` by a hash of their id, every query block meets every corpus block,
  and a pair of blocks emits k rows per query. The work is that of an exact
  search. A row is sent to every block of the other side, so from ``SPREAD`` blocks
  on it is the blocks that grow (to ``SPREAD * BLOCK`` rows), not their number.
* both sides large, approximate: the same block join inside cells (trained
  centroids, ``nprobe`` per query) or inside LSH buckets (several sign bits per
  table); a crowded cell or bucket is split into blocks on both sides.

Inside a block matrix products, a tile of rows at a time, give keys with a proven rounding
bound, in single precision first; every candidate within the bound of the k-th key so far is
scored again on differences, left to right, so ties and large offsets come out right. No
candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf

from .. import config
from ..functions import vector as V
from ..session import ship_package

SMALL = 100_000          # rows of a side declared small
BLOCK = 2048             # rows of a block, on average
SPREAD = 16              # blocks of a side before its blocks grow; how many times BLOCK they grow to
SAMPLE_PER_CELL = 64     # training vectors per centroid
ROWS_AT_ONCE = 256       # query rows scored together
ROWS_OF_TILE = 1024      # corpus rows that they meet at once
MORE = 16                # rows in question, times k, before keys of a query are made in double precision
PAIRS_AT_ONCE = 1 << 18  # candidate pairs scored together

_HITS = "qid long, cid long, score double"


# ---- scoring ----------------------------------------------------------------
def _stack(values) -> np.ndarray:
    """A list-like of vectors as a matrix of doubles."""
    if len(values) == 0:
        return np.zeros((0, 0))
    if isinstance(values, pa.Array):
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(values), -1)
    return np.vstack([np.asarray(x, dtype=np.float64) for x in values])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _exact_scores(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise scores of paired vectors, summed left to right (``cumsum``)
    exactly like the JVM fold and the SQL oracle's list sum."""
    if metric == "l2":
        d = q - c
        return np.cumsum(d * d, axis=1)[:, -1]
    dots = np.cumsum(q * c, axis=1)[:, -1]
    if metric == "dot":
        return dots
    size = np.sqrt(np.cumsum(q * q, axis=1)[:, -1]) * np.sqrt(np.cumsum(c * c, axis=1)[:, -1])
    return np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)


class _Keys:
    """Keys of queries against rows that rise with the rank, as one matrix product of numbers of ``kind``.

    ``error``: for each query a bound of the rounding error of its keys. In single precision all numbers are taken
    relative to the longest, so that none is too large or too small for it.
    """

    def __init__(self, metric: str, q: np.ndarray, c: np.ndarray, kind):
        unit = (2 if kind is np.float32 else 16) * (q.shape[1] + 8) * np.finfo(kind).eps
        self.metric, self.scale = metric, np.ones(len(q))
        one = np.ones((len(q), 1))
        if metric == "l2":
            middle = c.mean(axis=0)
            q, c = q - middle, c - middle            # one rounding per number, relative to the difference
            q2, c2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
            size = max(q2.max(), c2.max()) if kind is np.float32 else 1.0
            size = size if size > 0 else 1.0
            self.scale, self.q2 = np.full(len(q), size), q2
            a, b, self.error = np.hstack([q * (-2.0 / np.sqrt(size)), one]), np.hstack([c / np.sqrt(size), c2[:, None] / size]), unit * (q2 + c2.max()) / size
        elif metric == "cosine":
            a, b, self.error = -_unit(q), _unit(c), np.full(len(q), unit)
        else:
            far = np.linalg.norm(c, axis=1).max()
            if kind is np.float32:
                self.scale = np.linalg.norm(q, axis=1) * far
                self.scale[self.scale == 0] = 1.0
                a, b, self.error = -_unit(q), c / (far if far > 0 else 1.0), np.full(len(q), unit)
            else:
                a, b, self.error = -q, c, unit * np.linalg.norm(q, axis=1) * far
        self.a, self.b = a.astype(kind), b.astype(kind)

    def of(self, score: np.ndarray) -> np.ndarray:
        """The keys of scores."""
        return (score - self.q2) / self.scale if self.metric == "l2" else -score / self.scale


def _best(qid, cid, score, k: int, metric: str):
    """The k best rows of every query, by score and then cid."""
    order = np.lexsort((cid, score if V.ASCENDING[metric] else -score, qid))
    qid, cid, score = qid[order], cid[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], qid[1:] != qid[:-1]))) if qid.size else np.zeros(0, np.int64)
    at = np.arange(qid.size) - np.repeat(first, np.diff(np.append(first, qid.size)))
    keep = at < k
    return qid[keep], cid[keep], score[keep]


def _pairs_of_ids(qids: np.ndarray, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a query and a row with the same id, in order of the row."""
    order = np.argsort(cids, kind="stable")
    low, high = (np.searchsorted(cids, qids, side, sorter=order) for side in ("left", "right"))
    n = high - low
    row = np.repeat(np.arange(len(qids)), n)
    col = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    by = np.argsort(col, kind="stable")
    return row[by], col[by]


def _upward(limit: np.ndarray, kind) -> np.ndarray:
    """A column of the limits, rounded up to numbers of ``kind``."""
    return np.nextafter(limit.astype(kind), np.array(np.inf, kind))[:, None]


def _places(within: np.ndarray) -> np.ndarray:
    """The places of the few true ones in a table of truth values, eight looked at together."""
    flat = within.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    row, at = np.nonzero(flat.reshape(-1, 8)[some])
    return some[row] * 8 + at


def _near(keys: _Keys, rows: slice, own: tuple[np.ndarray, np.ndarray], k: int, worst: np.ndarray, most: int):
    """Places (query, row) of the pairs that can be among the k best of a query, whose key is not above ``worst``; None
    if there are more than ``most``."""
    a, b = keys.a[rows], keys.b
    n, twice = len(a), 2 * keys.error[rows]
    limit = worst + twice
    held, seen, due = [], 0, 1
    for tile, s in enumerate(range(0, len(b), ROWS_OF_TILE), 1):
        key = a @ b[s:s + ROWS_OF_TILE].T
        lo, hi = np.searchsorted(own[1], [s, s + ROWS_OF_TILE])
        key[own[0][lo:hi], own[1][lo:hi] - s] = np.inf
        within = key <= _upward(limit, key.dtype)
        if np.count_nonzero(within) > 8 * k * n and key.shape[1] > k:
            kth = np.partition(key, k - 1, axis=1)[:, k - 1]
            limit = np.fmin(limit, kth + twice)
            within = key <= _upward(limit, key.dtype)
        r, c = np.divmod(_places(within), key.shape[1])
        found = key[r, c]
        there = np.isfinite(found)
        held.append((r[there], c[there] + s, found[there]))
        seen += there.sum()
        # the k-th best so far, each time there are twice as many rows
        if tile == due or s + ROWS_OF_TILE >= len(b):
            due *= 2
            r, c, found = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((found, r))
            r, c, found = r[order], c[order], found[order]
            first, count = np.searchsorted(r, np.arange(n)), np.bincount(r, minlength=n)
            full = np.flatnonzero(count >= k)
            limit[full] = np.fmin(limit[full], found[first[full] + k - 1] + twice[full])
            keep = found <= limit[r]
            held = [(r[keep], c[keep], found[keep])]
            seen = keep.sum()
        if seen > most:
            return None
    return held[0][:2]


def rank_block(metric: str, qids, q: np.ndarray, cids, c: np.ndarray, k: int, exclude_self: bool, worst: np.ndarray | None = None):
    """Exact top k of every query among the corpus rows given: (qid, cid, score) arrays; with ``worst``, a score for every
    query, rows that are worse may be left out.

    Keys are made in single precision, or in double precision where its rounding leaves too many rows in question.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if len(qids) == 0 or len(cids) == 0:
        return none
    out, wide = [none], None
    own = _pairs_of_ids(qids, cids) if exclude_self else (np.zeros(0, np.int64),) * 2
    step = max(ROWS_AT_ONCE, min(16 * ROWS_AT_ONCE, ROWS_AT_ONCE * ROWS_OF_TILE // len(cids)))
    with np.errstate(over="ignore", invalid="ignore"):
        fast = _Keys(metric, q, c, np.float32)

        def near(keys: _Keys, s: int, most: int):
            rows = slice(s, s + step)
            here = (own[0] >= s) & (own[0] < s + step)
            limit = np.full(len(qids[rows]), np.inf)
            if worst is not None:
                reach = keys.of(worst)[rows]
                limit = np.where(np.isnan(reach), np.inf, reach)
            return _near(keys, rows, (own[0][here] - s, own[1][here]), k, limit, most)

        for s in range(0, len(qids), step):
            qi, qm = qids[s:s + step], q[s:s + step]
            got = near(fast, s, MORE * max(k, 16) * len(qi)) if np.isfinite(fast.error[s:s + step]).all() else None
            if got is None:
                wide = wide or _Keys(metric, q, c, np.float64)
                got = near(wide, s, len(qi) * len(cids))
            rows, cols = got
            held = [none]
            for a in range(0, rows.size, PAIRS_AT_ONCE):
                r, x = rows[a:a + PAIRS_AT_ONCE], cols[a:a + PAIRS_AT_ONCE]
                held.append(_best(qi[r], cids[x], _exact_scores(metric, qm[r], c[x]), k, metric))
            out.append(_best(*(np.concatenate(p) for p in zip(*held)), k, metric))
    return tuple(np.concatenate(p) for p in zip(*out))


def top_k(scored: DataFrame, k: int, metric: str) -> DataFrame:
    s = F.col("score").asc() if V.ASCENDING[metric] else F.col("score").desc()
    w = Window.partitionBy("qid").orderBy(s, F.col("cid").asc())
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                  .select("qid", "cid", "score", "rank"))


# ---- one side declared small ------------------------------------------------
def _shipped(side: DataFrame, key: str):
    """Ids and matrix of a side declared small, as a broadcast variable."""
    rows = side.orderBy(key).limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"the side declared small has more than {SMALL} rows")
    data = np.array([r[key] for r in rows], np.int64), _stack([r["vec"] for r in rows])
    return side.sparkSession.sparkContext.broadcast(data)


def _hits(qid, cid, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(cid, pa.int64()),
                                       pa.array(score, pa.float64())], names=["qid", "cid", "score"])


def _small_queries(queries: DataFrame, corpus: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    shared = _shipped(queries, "qid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:                       # the best so far of every query, k rows each
            got = rank_block(metric, qids, q, b.column(0).to_numpy(), _stack(b.column(1)), k, exclude_self)
            best = _best(*(np.concatenate(p) for p in zip(best, got)), k, metric)
        yield _hits(*best)
    return top_k(corpus.select("cid", "vec").mapInArrow(run, _HITS), k, metric)


def _small_corpus(queries: DataFrame, corpus: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    shared = _shipped(corpus, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, c = shared.value
        for b in batches:
            qids = b.column(0).to_numpy()
            place, where = np.arange(len(qids)), _stack(b.column(1))    # repeated query ids rank apart
            if exclude_self:
                got = rank_block(metric, qids, where, cids, c, k, True)
                qid = got[0]
            else:
                got = rank_block(metric, place, where, cids, c, k, False)
                qid = qids[got[0]]
            first = np.flatnonzero(np.concatenate(([True], got[0][1:] != got[0][:-1]))) if got[0].size else np.zeros(0, np.int64)
            rank = np.arange(got[0].size) - np.repeat(first, np.diff(np.append(first, got[0].size))) + 1
            yield pa.RecordBatch.from_arrays([*_hits(qid, got[1], got[2]).columns, pa.array(rank, pa.int32())],
                                             names=["qid", "cid", "score", "rank"])
    return queries.select("qid", "vec").mapInArrow(run, _HITS + ", rank int")


# ---- both sides large: blocks -----------------------------------------------
def _block_join(q: DataFrame, c: DataFrame, k: int, metric: str, exclude_self: bool, block: int = BLOCK,
               rank=None) -> DataFrame:
    """(qid, cid, score) of ``q(qid, vec, cell)`` against ``c(cid, vec, cell)`` of the same cell.

    Both sides of a cell are split into blocks of about ``block`` rows (more of a cell with
    over ``SPREAD`` blocks); a group is one pair of blocks and emits at most k rows per query.
    ``rank(queries, rows)`` scores a pair of blocks in another way than all with all (frames
    with all columns given).
    """
    q_more, c_more = ([x for x in df.columns if x not in ("qid", "cid", "vec", "cell")] for df in (q, c))
    rows = F.count(F.lit(1))
    n_blocks = F.least(F.ceil(rows / F.lit(block)), F.greatest(F.lit(SPREAD), F.ceil(rows / F.lit(SPREAD * block))))
    blocks = lambda df, n: df.groupBy("cell").agg(n_blocks.cast("int").alias(n))
    sizes = blocks(q, "qn").join(blocks(c, "cn"), "cell")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qs = (q.join(sizes, "cell").withColumn("qb", deal("qid", "qn")).withColumn("cb", every("cn"))
           .select(F.col("cell").alias("qcell"), "qb", "cb", "qid", F.col("vec").alias("qvec"), *q_more))
    cs = (c.join(sizes, "cell").withColumn("cb", deal("cid", "cn")).withColumn("qb", every("qn"))
           .select("cell", "qb", "cb", "cid", "vec", *c_more))

    def best(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if rank is not None:
            got = rank(qdf, cdf)
        else:
            got = rank_block(metric, qdf["qid"].to_numpy(np.int64), _stack(qdf["qvec"].values),
                             cdf["cid"].to_numpy(np.int64), _stack(cdf["vec"].values), k, exclude_self)
        return pd.DataFrame(dict(zip(("qid", "cid", "score"), got)))
    return (qs.groupBy("qcell", "qb", "cb").cogroup(cs.groupBy("cell", "qb", "cb"))
              .applyInPandas(best, _HITS))


class CellIndex:
    """Centroids (cells) in a broadcast variable; its size is fixed by their number."""

    def __init__(self, spark, ids: np.ndarray, centres: np.ndarray, metric: str):
        order = np.argsort(ids, kind="stable")
        self.metric = metric
        centres = centres[order]
        self.shared = spark.sparkContext.broadcast(
            (ids[order].astype(np.int64), _unit(centres) if metric == "cosine" and centres.size else centres))

    def nearest(self, n: int):
        """UDF: the ids of the n nearest cells of a vector, nearest first."""
        shared, metric = self.shared, self.metric

        @pandas_udf("array<long>")
        def cells(v: pd.Series) -> pd.Series:
            ids, centres = shared.value
            x = _stack(v.values)
            if x.shape[0] == 0 or ids.size == 0:
                return pd.Series([[] for _ in range(len(v))], dtype=object)
            if metric == "dot":
                key = -(x @ centres.T)
            else:
                x = _unit(x) if metric == "cosine" else x
                key = np.stack([np.einsum("ij,ij->i", x - m, x - m) for m in centres], axis=1)
            order = np.argsort(key, axis=1, kind="stable")[:, :n]
            return pd.Series([ids[o].tolist() for o in order])
        return cells


def train_cells(corpus: DataFrame, metric: str, n_cells: int, rounds: int = 8) -> CellIndex:
    """Centroids by Lloyd's rounds on a bounded sample (``SAMPLE_PER_CELL`` vectors per cell,
    the first by a hash of the id)."""
    rows = corpus.orderBy(F.xxhash64("cid"), "cid").limit(n_cells * SAMPLE_PER_CELL).select("cid", "vec").collect()
    x = _stack([r["vec"] for r in rows])
    x = _unit(x) if metric == "cosine" and x.size else x
    centres = np.unique(x[:n_cells], axis=0) if x.size else x
    for _ in range(rounds if x.size else 0):
        near = np.stack([np.einsum("ij,ij->i", x - m, x - m) for m in centres], axis=1).argmin(axis=1)
        centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
    return CellIndex(corpus.sparkSession, np.arange(len(centres)), centres, metric)


def cells_from_table(centroids: DataFrame, metric: str) -> CellIndex:
    """Fixed cells given as ``(c, embedding)``: a table declared small."""
    rows = centroids.orderBy("c").limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"more than {SMALL} cells")
    return CellIndex(centroids.sparkSession, np.array([r["c"] for r in rows], np.int64),
                     _stack([r["embedding"] for r in rows]), metric)


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False,
        exact: bool = True, nprobe: int = config.SEARCH_NPROBE, n_cells: int = 256,
        cells: CellIndex | None = None, small: str | None = None, block: int = BLOCK) -> DataFrame:
    """k nearest corpus vectors of every query -> (qid, cid, score, rank)."""
    ship_package(corpus.sparkSession)
    q = queries.select("qid", "vec").where("vec is not null")
    c = corpus.select("cid", "vec").where("vec is not null")
    if small == "queries":
        return _small_queries(q, c, k, metric, exclude_self)
    if small == "corpus":
        return _small_corpus(q, c, k, metric, exclude_self)
    if exact:
        q, c = q.withColumn("cell", F.lit(0).cast("long")), c.withColumn("cell", F.lit(0).cast("long"))
    else:
        index = cells or train_cells(c, metric, n_cells)
        q = q.withColumn("cell", F.explode(index.nearest(nprobe)("vec")))
        c = c.withColumn("cell", F.explode(index.nearest(1)("vec")))
    return top_k(_block_join(q, c, k, metric, exclude_self, block), k, metric)


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int, num_tables: int = 12, bits: int = 7,
            seed: int = 7, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """V3: approximate cosine search by random hyperplanes.

    A table's key is the signs of ``bits`` projections, so a bucket holds about
    2^-bits of spread-out data; vectors meet inside a bucket only, in blocks, and
    are ranked by their exact cosine.
    """
    ship_package(corpus.sparkSession)

    @pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        x = _stack(v.values)
        if x.shape[0] == 0:
            return pd.Series([], dtype=object)
        planes = np.random.default_rng(seed).normal(size=(x.shape[1], num_tables * bits))
        sign = (x @ planes > 0).reshape(len(x), num_tables, bits)
        key = sign @ (1 << np.arange(bits)) + (np.arange(num_tables) << bits)[None, :]
        return pd.Series(key.tolist())

    q = queries.select("qid", "vec").where("vec is not null").withColumn("cell", F.explode(buckets("vec")))
    c = corpus.select("cid", "vec").where("vec is not null").withColumn("cell", F.explode(buckets("vec")))
    hits = _block_join(q, c, k, "cosine", exclude_self, block).groupBy("qid", "cid").agg(F.first("score").alias("score"))
    return top_k(hits, k, "cosine")
