"""A stored cell index over vectors: inverted lists by cell, appended to and searched in place (V2, K4, V1).

Folder of an index::

    versions/                 one row per finished build: version, metric, cells, columns, build (a fresh name)
    centroids/build/          cell, centre
    radii/build/              cell, radius, rows: one part per build or append
    lists/build/cell=c/       the vectors of a cell with all their columns, and ``far``
                              (distance to the cell's centre)

* ``build`` trains the cells (or takes them as given) and writes the lists; ``append``
  assigns new vectors to the cells of the current version and adds to their lists, ids
  already stored are left out, so a replay adds nothing; ``rebuild`` writes a next version
  with cells for the rows there are now. A version counts once its row in ``versions`` is
  written, after its files. Radii are written before the vectors they bound, so a failed
  append can make a radius too large but never too small.
* The number of cells follows the rows (their square root), and so does the training
  sample (``SAMPLE_PER_CELL`` vectors a cell, by a hash of the id), which Spark's k-means
  takes as a table. A crowded cell is written by several tasks.
* ``search`` probes the ``nprobe`` nearest cells of each query. With ``small="queries"`` the
  probed cells are known first, and the scan of the lists is pruned to their folders.
* ``search_exact`` gives the true k nearest by the triangle inequality. The nearest cells
  that hold k vectors give every query a distance that its k-th neighbour can't exceed
  (its reach); then it meets only cells with distance to the centre - radius <= reach,
  and in these only vectors whose ``far`` is within reach of the query's own
  distance to the centre. Cells lie on shelves: a query is sent once to a shelf, with the
  cells there that it meets, not once to every cell. Distances come from a matrix product;
  the bounds are widened by more than its rounding error. Cosine works on unit vectors; dot products have no such
  bound and are refused.

Rows with a null vector take no part. The centres are broadcast; more than
``CENTRE_BYTES`` of them is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config
from ..functions import vector as V
from ..session import read_or_none, scratch_path, ship_package
from . import knn as K

SAMPLE_PER_CELL = 64
ROUNDS = 8                       # of k-means
CENTRE_BYTES = 512 << 20
ROWS_PER_FILE = 1 << 20
PAIRS_AT_ONCE = 1 << 20          # distances to centres computed at once
HITS_AT_ONCE = 1 << 20           # hits of a shelf's cells before they are cut
_VERSION = "version long, metric string, cells long, columns string, build string"


def _points(metric: str, x: np.ndarray) -> np.ndarray:
    """Points whose Euclidean distance ranks like the metric."""
    return K._unit(x) if metric == "cosine" and x.size else x


def _distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all x to all centres, and for each x a bound of their rounding error."""
    x2, c2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", centres, centres)
    d = np.sqrt(np.maximum(x2[:, None] - 2.0 * (x @ centres.T) + c2[None, :], 0.0))
    error = 16 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (x2 + c2.max())
    return d, np.sqrt(error) + 1e-12


class CellStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ship_package(spark)

    # ---- versions ----
    def current(self):
        """The row of the last finished build, or None."""
        rows = read_or_none(self.spark, f"{self.path}/versions", _VERSION)
        return None if rows is None else rows.orderBy(F.desc("version")).first()

    def _at(self, kind: str, build: str) -> str:
        return f"{self.path}/{kind}/{build}"

    def lists(self, now=None) -> DataFrame:
        """All stored vectors: the columns they came with, far, cell."""
        now = now or self.current()
        return self.spark.read.schema(now.columns + ", far double, cell long").parquet(self._at("lists", now.build))

    def _centres(self, build: str):
        rows = self.spark.read.parquet(self._at("centroids", build))
        size = rows.agg(F.sum(F.size("centre"))).first()[0] or 0
        if 8 * size > CENTRE_BYTES:
            raise ValueError(f"the centres take more than {CENTRE_BYTES} bytes")
        table = rows.orderBy("cell").toArrow()                  # at most CENTRE_BYTES
        ids = table.column("cell").to_numpy().astype(np.int64)
        return ids, K._stack(table.column("centre").combine_chunks()) if len(ids) else np.zeros((0, 0))

    # ---- writing ----
    def build(self, vectors: DataFrame, metric: str = "l2", cells: DataFrame | None = None, n_cells: int | None = None) -> None:
        """A new version from ``vectors(cid, vec, ...)``; ``cells(c, embedding)`` gives the centres, else they are trained."""
        if metric not in V.ASCENDING:
            raise ValueError(f"unknown metric {metric}")
        before, build = self.current(), uuid.uuid4().hex[:12]
        vectors = vectors.where("vec is not null")
        if cells is None:
            cells = self._trained(vectors, metric, n_cells)
        cells = cells.select(F.col("c").cast("long").alias("cell"), F.col("embedding").cast("array<double>").alias("centre"))
        cells.write.parquet(self._at("centroids", build))
        self._write(vectors, build, metric)
        n = self.spark.read.parquet(self._at("centroids", build)).count()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        row = (1 if before is None else before.version + 1, metric, n, columns, build)
        self.spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def _trained(self, vectors: DataFrame, metric: str, n_cells: int | None) -> DataFrame:
        rows = vectors.count()
        n = n_cells or max(1, round(rows ** 0.5))
        share = max(1, rows // (n * SAMPLE_PER_CELL))
        vec = V.normalize("vec") if metric == "cosine" else F.col("vec")
        sample = vectors.where(F.pmod(F.xxhash64("cid"), F.lit(share)) == 0).select(
            array_to_vector(vec.cast("array<double>")).alias("features"))
        if rows == 0:
            return self.spark.createDataFrame([], "c long, embedding array<double>")
        centres = KMeans(k=n, maxIter=ROUNDS, seed=7, initMode="random").fit(sample).clusterCenters()
        return self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "c long, embedding array<double>")

    def append(self, vectors: DataFrame) -> None:
        """Adds the vectors whose ids are not stored; of rows that repeat an id, one is added."""
        now = self.current()
        new = vectors.where("vec is not null").dropDuplicates(["cid"]).join(
            self.lists(now).select("cid"), "cid", "left_anti")
        own = [c for c in self.lists(now).columns if c not in ("far", "cell")]
        self._write(new.select(*[F.col(f"`{c}`") for c in own]), now.build, now.metric)

    def rebuild(self, n_cells: int | None = None) -> None:
        """A next version with cells trained on the vectors stored now."""
        now = self.current()
        self.build(self.lists(now).drop("cell", "far"), now.metric, n_cells=n_cells)

    def _write(self, vectors: DataFrame, build: str, metric: str) -> None:
        rows = self._staged(self._assigned(vectors, build, metric), "cell-rows")
        sizes = self._staged(rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows")), "cell-sizes")
        sizes.coalesce(1).write.mode("append").parquet(self._at("radii", build))
        part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / ROWS_PER_FILE))
        (rows.join(sizes.select("cell", F.col("rows").alias("n")), "cell").withColumn("part", part).repartition("cell", "part")
             .drop("n", "part").write.mode("append").partitionBy("cell").parquet(self._at("lists", build)))

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _assigned(self, vectors: DataFrame, build: str, metric: str) -> DataFrame:
        """The vectors with their distance to the centre of their nearest cell, and that cell."""
        centres = self.spark.sparkContext.broadcast(self._centres(build))
        at = vectors.columns.index("vec")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, c = centres.value
            for b in batches:
                x = _points(metric, K._stack(b.column(at)))
                if not len(x):
                    continue
                cell, far = np.empty(len(x), np.int64), np.empty(len(x))
                step = max(1, PAIRS_AT_ONCE // len(ids))
                for s in range(0, len(x), step):
                    some = x[s:s + step]
                    d, error = _distances(some, c)
                    # all centres within the rounding error are measured on differences; ties go to the smallest cell
                    row, j = np.nonzero(d <= (d.min(axis=1) + 2 * error)[:, None])
                    exact = np.cumsum((some[row] - c[j]) ** 2, axis=1)[:, -1]
                    order = np.lexsort((j, exact, row))
                    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                    cell[s:s + step], far[s:s + step] = ids[j[first]], np.sqrt(exact[first])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far), pa.array(cell)], names=[*b.schema.names, "far", "cell"])
        return vectors.mapInArrow(run, _with(vectors, "far double, cell long"))

    # ---- reading ----
    def _probes(self, queries: DataFrame, build: str, metric: str, nprobe: int) -> DataFrame:
        ids, c = self._centres(build)
        index = K.CellIndex(self.spark, ids, c, metric)
        return queries.select("qid", "vec").where("vec is not null").withColumn("cell", F.explode(index.nearest(nprobe)("vec")))

    def search(self, queries: DataFrame, k: int, nprobe: int = config.SEARCH_NPROBE, where: Column | str | None = None,
               exclude_self: bool = False, small: str | None = None, block: int = K.BLOCK) -> DataFrame:
        """The k nearest of the vectors in the ``nprobe`` nearest cells -> (qid, cid, score, rank).

        ``where`` is a condition on the stored columns, applied before the ranking.
        """
        now = self.current()
        q = self._probes(queries, now.build, now.metric, nprobe)
        rows = self.lists(now)
        rows = rows if where is None else rows.where(where)
        if small == "queries":
            if queries.limit(K.SMALL + 1).count() > K.SMALL:
                raise ValueError(f"the side declared small has more than {K.SMALL} rows")
            q = self._staged(q, "cell-probes")
            cells = [r.cell for r in q.select("cell").distinct().collect()]             # at most the cells there are
            rows = rows.where(F.col("cell").isin(cells))
        hits = K._block_join(q, rows.select("cid", "vec", "cell"), k, now.metric, exclude_self, block)
        return K.top_k(hits, k, now.metric)

    def search_exact(self, queries: DataFrame, k: int, exclude_self: bool = False, where: Column | str | None = None,
                     block: int = K.BLOCK) -> DataFrame:
        """The k nearest of all stored vectors -> (qid, cid, score, rank)."""
        hits = self._exact_hits(queries, k, exclude_self, where, block)[0]
        return K.top_k(hits, k, self.current().metric)

    def _exact_hits(self, queries: DataFrame, k: int, exclude_self: bool, where, block: int) -> tuple[DataFrame, list[DataFrame]]:
        """The hits, and what each query meets: (qid, cell) of the two passes."""
        now = self.current()
        metric = now.metric
        if metric == "dot":
            raise ValueError("dot products have no triangle inequality")
        rows = self.lists(now)
        rows = (rows if where is None else rows.where(where)).select("cid", "vec", "cell", "far")
        ids, c = self._centres(now.build)
        size = self.spark.read.schema("cell long, radius double, rows long").parquet(self._at("radii", now.build)) \
            .groupBy("cell").agg(F.max("radius").alias("radius")).join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell")
        known = {r.cell: (r.radius, r.n) for r in size.collect()}                       # a row per cell
        radius = np.array([known.get(i, (0.0, 0))[0] for i in ids.tolist()])
        n = np.array([known.get(i, (0.0, 0))[1] for i in ids.tolist()], np.int64)
        shared = self.spark.sparkContext.broadcast((ids, c, radius, n))
        queries = queries.select("qid", "vec").where("vec is not null")
        need = k + exclude_self
        first = self._staged(queries.mapInArrow(_nearest_cells(shared, metric, need), _with(queries, "cell long")), "exact-first")
        near = self._staged(K._block_join(first.select("qid", "vec", "cell"), rows.select("cid", "vec", "cell"), k, metric, exclude_self, block), "exact-near")
        kth = K.top_k(near, k, metric).where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("score").alias("kth"))
        bounded = queries.join(kth, F.col("qid") == F.col("id"), "left").select("qid", "vec", "kth")
        shelf, shelf_rows = _shelves(n, block)
        more = self._staged(bounded.mapInArrow(_reached_cells(shared, shelf, metric, need), StructType(
            [*queries.schema.fields, *StructType.fromDDL("cell long, cells array<long>, own array<double>, reach double").fields])), "exact-more")
        places = self.spark.createDataFrame(list(zip(ids.tolist(), shelf.tolist())), "cell long, shelf long")
        placed = rows.join(F.broadcast(places), "cell").select("cid", "vec", F.col("shelf").alias("cell"), F.col("cell").alias("part"), "far")
        rest = K._block_join(more, placed, k, metric, exclude_self, shelf_rows, rank=_by_cell(metric, k, exclude_self))
        return near.unionByName(rest), [first.select("qid", "cell"), more.select("qid", F.explode("cells").alias("cell"))]

    def pairs_met(self, passes: list[DataFrame]) -> int:
        """Pairs of a query and a vector that an exact search looks at, cell by cell."""
        n = self.lists().groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return sum(p.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(n, "cell").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0
                   for p in passes)


def _with(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def _nearest_cells(shared, metric: str, need: int):
    """For each query the nearest cells that together hold ``need`` vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, _, n = shared.value
        for b in batches:
            x = _points(metric, K._stack(b.column(1)))
            if not len(x) or not len(ids):
                continue
            step = max(1, PAIRS_AT_ONCE // len(ids))
            for s in range(0, len(x), step):
                order = np.argsort(_distances(x[s:s + step], c)[0], axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                take = np.concatenate((np.ones((len(order), 1), bool), held[:, :-1] < need), axis=1) & (n[order] > 0)
                row, at = np.nonzero(take)
                own = b.slice(s, step).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids[order[row, at]])], names=["qid", "vec", "cell"])
    return run


def _shelves(n: np.ndarray, block: int) -> tuple[np.ndarray, int]:
    """The shelf of every cell, cells in order, and about how many vectors a shelf has: those of a block (``_block_join``)."""
    rows = min(K.SPREAD * block, max(block, int(n.sum()) // K.SPREAD))
    return (np.cumsum(n) - n) // rows, rows


def _reached_cells(shared, shelf: np.ndarray, metric: str, need: int):
    """For each query and shelf the cells, but for those of the first pass, that can hold one of its nearest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, radius, n = shared.value
        for b in batches:
            vec = K._stack(b.column(1))
            x = _points(metric, vec)
            if not len(x) or not len(ids):
                continue
            kth = b.column(2).to_numpy(zero_copy_only=False)
            reach = np.sqrt(np.maximum(kth if metric == "l2" else 2.0 - 2.0 * kth, 0.0))
            reach[np.isnan(reach)] = np.inf                     # fewer than k so far
            step = max(1, PAIRS_AT_ONCE // len(ids))
            for s in range(0, len(x), step):
                d, error = _distances(x[s:s + step], c)
                order = np.argsort(d, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                seen = np.zeros(d.shape, bool)
                np.put_along_axis(seen, order, np.concatenate((np.ones((len(order), 1), bool), held[:, :-1] < need), axis=1), axis=1)
                # wider than the rounding of d, far and radius
                wide = reach[s:s + step] * (1 + 1e-9) + 2 * error
                row, at = np.nonzero((d - radius[None, :] <= wide[:, None]) & (n > 0)[None, :] & ~seen)
                if not row.size:
                    continue
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shelf[at[1:]] != shelf[at[:-1]])])
                own = b.slice(s, step).take(pa.array(row[start]))
                offsets = pa.array(np.r_[start, row.size], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(shelf[at[start]]), pa.ListArray.from_arrays(offsets, pa.array(ids[at])),
                     pa.ListArray.from_arrays(offsets, pa.array(d[row, at])), pa.array(wide[row[start]])],
                    names=["qid", "vec", "cell", "cells", "own", "reach"])
    return run


def _by_cell(metric: str, k: int, exclude_self: bool):
    """The k best of a shelf for each query, from the cells that it meets there."""
    def rank(queries, rows):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(rows):
            qid, q, reach = queries["qid"].to_numpy(np.int64), K._stack(queries["qvec"].values), queries["reach"].to_numpy(np.float64)
            worst = reach ** 2 if metric == "l2" else 1.0 - reach ** 2 / 2      # the score at the end of the reach
            of = np.repeat(np.arange(len(qid)), queries["cells"].str.len().to_numpy(np.int64))
            cells, own = np.concatenate(queries["cells"].to_numpy()), np.concatenate(queries["own"].to_numpy())
            order = np.argsort(cells, kind="stable")
            cells, own, of = cells[order], own[order], of[order]
            cid, c, far = rows["cid"].to_numpy(np.int64), K._stack(rows["vec"].values), rows["far"].to_numpy(np.float64)
            part = rows["part"].to_numpy(np.int64)
            by = np.argsort(part, kind="stable")
            for j in np.intersect1d(part, cells):
                meet = slice(*np.searchsorted(cells, [j, j + 1]))
                some = by[slice(*np.searchsorted(part, [j, j + 1], sorter=by))]
                some = some[_within_reach(own[meet], reach[of[meet]], far[some])]
                held.append(K.rank_block(metric, qid[of[meet]], q[of[meet]], cid[some], c[some], k, exclude_self, worst[of[meet]]))
                if sum(x[0].size for x in held) > HITS_AT_ONCE:
                    held = [K._best(*(np.concatenate(x) for x in zip(*held)), k, metric)]
        return K._best(*(np.concatenate(x) for x in zip(*held)), k, metric)
    return rank


def _within_reach(own: np.ndarray, reach: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Rows whose distance to the centre is within reach of that of some query."""
    order = np.argsort(own - reach)
    low, high = (own - reach)[order], np.maximum.accumulate((own + reach)[order])
    at = np.searchsorted(low, far, "right") - 1                 # the widest interval that begins before the row
    return (at >= 0) & (far <= high[np.maximum(at, 0)])
