"""Operator 8: perplexity by an interpolated modified Kneser-Ney bigram model.

Counted in Spark, stored as sorted hash arrays, memory-mapped by the workers.

* Words. Each task counts 64-bit word hashes; blocks of (sorted hashes, counts) are
  shuffled by hash range and merged into one sorted array per range. A word's id is
  its place in these arrays. The end of a text is a word; its start is an entry
  with count 0 that only serves as a context.
* Pairs. A pair is (id of the context, id of the word) in one 64-bit number, so
  pairs don't collide. Each task counts pairs and sends sorted blocks to the shard
  of the context; a context with many occurrences is dealt to several shards by the
  word, so no shard grows with one hot word. A shard is merged, saved sorted, and
  reports what the lower order needs: per context the total and how many words
  follow once, twice, more often; per word in how many contexts it occurs. All
  n-grams are kept: no pruning, no cap.
* Probability, with D by count (1, 2, 3+) from the count-of-counts n1..n4:
  P(w | v) = (c(vw) - D(c)) / c(v.) + lambda(v) P(w), P(w) the same formula over
  the numbers of contexts, interpolated with 1 / (V + 1). An unseen context gives P(w).
* Scoring. Texts are read in blocks; ids and pairs of a block are looked up as
  sorted queries, so that pages of the mapped files are read in order.

The files lie in a folder that all workers mount (``spark.checkpoint.dir`` as a
path or file: address); page cache holds them, not worker memory. Shards follow the
number of input partitions. A task that is run again writes the same file.

Rows: a null text is empty (one token, the end). A null id counts as the empty
text for the fold. Rows repeating an id are scored one by one and all learnt from.
Without training text every probability is 1 / (V + 1) = 1, so scores are 0.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLD = 10
SHARDS_PER_PARTITION = 4
HOT = 1 << 21                    # occurrences of a context per shard that it is dealt to
BLOCK_BYTES = 4 << 20            # text scored at once: larger blocks look more words up in order
FLUSH = 2 << 20                  # tokens that a task gathers before it sends a block
START, END = C.mix(np.array([0x5354415254, 0x454E44], np.uint64)).tolist()
_U = np.uint64


# ---- blocks: sorted numbers as differences in byte planes, which Spark's codec packs well ---
def squeeze(a: np.ndarray) -> bytes:
    d = a.astype(np.uint64)
    d[1:] -= a[:-1].astype(np.uint64)
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def unsqueeze(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if k.size else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if k.size else c)


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if a.size else 0))


def _file(folder: str, kind: str, shard: int) -> str:
    return os.path.join(folder, f"{kind}-{shard:05d}.npy")


def _save(folder: str, kind: str, shard: int, a: np.ndarray) -> None:
    path = _file(folder, kind, shard)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, path)


class Shards:
    """Memory-mapped arrays of one kind, opened when first used."""

    def __init__(self, folder: str, *kinds: str):
        self.folder, self.kinds = folder, kinds
        self.open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getitem__(self, shard: int) -> tuple[np.ndarray, ...]:
        if shard not in self.open:
            self.open[shard] = tuple(np.load(_file(self.folder, k, shard), mmap_mode="r") for k in self.kinds)
        return self.open[shard]


# ---- words -------------------------------------------------------------------------
def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first token of each text): the words of every text and its end."""
    data, off = C.buffer(texts)
    s, e, first = C.word_spans(data, off)
    h = C.word_hashes(data, s, e)
    n = len(texts)
    out = np.empty(h.size + n, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(h.size) + doc] = h
    bounds = first + np.arange(n + 1)
    out[bounds[1:] - 1] = END
    return out, bounds


def _cuts(sorted_: np.ndarray, bits: int) -> np.ndarray:
    """Where the 2^bits hash ranges begin in a sorted array (one more place at the end)."""
    if not bits:
        return np.array([0, sorted_.size])
    starts = np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)
    return np.append(np.searchsorted(sorted_, starts), sorted_.size)


def _blocks(batches, count, rows):
    """Gathers the arrays that ``count`` makes of text slices and yields their counted blocks."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for part in C.slices(batch):
            held.append(count(part.column(0)))
            size += held[-1].size
            if size >= FLUSH:
                yield from rows(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
    if held:
        yield from rows(*np.unique(np.concatenate(held), return_counts=True))


_BLOCK = "shard int, keys binary, counts binary"


def _row(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([squeeze(keys)], pa.binary()),
                                       pa.array([planes(counts)], pa.binary())], names=["shard", "keys", "counts"])


def _word_blocks(bits: int):
    def rows(keys, counts):
        cut = _cuts(keys, bits)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            yield _row(i, keys[cut[i]:cut[i + 1]], counts[cut[i]:cut[i + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(np.array([START], np.uint64), np.zeros(1, np.int64))
        yield from _blocks(batches, lambda texts: tokens(texts)[0], rows)
    return run


def _merge_words(folder: str):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([unsqueeze(b) for b in df["keys"]], [unplanes(b).astype(np.int64) for b in df["counts"]])
        _save(folder, "word", int(key[0]), k)
        _save(folder, "count", int(key[0]), _small(c))
        return pd.DataFrame({"shard": [int(key[0])], "n": [k.size], "total": [int(c.sum())]})
    return run


class Words:
    """Ids of word hashes: places in the sorted arrays of all hash ranges."""

    def __init__(self, folder: str, bits: int, offsets: np.ndarray):
        self.bits, self.offsets = bits, offsets
        self.shards = Shards(folder, "word", "count")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of each hash."""
        u, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(u.size, -1, np.int64), np.zeros(u.size, np.int64)
        cut = _cuts(u, self.bits)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            n = self.offsets[i + 1] - self.offsets[i]
            if n:
                words, count = self.shards[i]
                q = u[cut[i]:cut[i + 1]]
                at = np.minimum(np.searchsorted(words, q), n - 1)
                hit = words[at] == q
                ids[cut[i]:cut[i + 1]] = np.where(hit, at + self.offsets[i], -1)
                counts[cut[i]:cut[i + 1]] = np.where(hit, count[at], 0)
        return ids[back], counts[back]


# ---- pairs -------------------------------------------------------------------------
def _context(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The id before each token."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1]] = start
    return out


def _shard_of(context: np.ndarray, word: np.ndarray, count: np.ndarray, shards: int) -> np.ndarray:
    parts = (count // HOT + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        part = np.where(parts > _U(1), C.mix(word.astype(np.uint64) + C.GOLDEN) % parts, _U(0))
        return ((C.mix(context.astype(np.uint64)) + part) & _U(shards - 1)).astype(np.int64)


def _pair_blocks(folder: str, bits: int, offsets: np.ndarray, start: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(folder, bits, offsets)

        def count(texts):
            h, bounds = tokens(texts)
            ids, _ = words.find(h)
            return _context(ids, bounds, start[0]).astype(np.uint64) << _U(32) | ids.astype(np.uint64)

        def rows(keys, counts):
            context = (keys >> _U(32)).astype(np.int64)
            seen = words_counts(words, offsets, context)
            shard = _shard_of(context, (keys & _U(0xFFFFFFFF)).astype(np.int64),
                              np.where(context == start[0], start[1], seen), 1 << bits)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                some = order[cut[i]:cut[i + 1]]
                yield _row(i, keys[some], counts[some])
        yield from _blocks(batches, count, rows)
    return run


def words_counts(words: Words, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Training counts of sorted ids."""
    out = np.zeros(ids.size, np.int64)
    cut = np.searchsorted(ids, offsets)
    for i in np.flatnonzero(np.diff(cut)).tolist():
        out[cut[i]:cut[i + 1]] = words.shards[i][1][ids[cut[i]:cut[i + 1]] - offsets[i]]
    return out


_STATS = "part int, kind string, ids binary, total binary, once binary, twice binary, more binary, n1 long, n2 long, n3 long, n4 long"


def _merge_pairs(folder: str, offsets: np.ndarray):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([unsqueeze(b) for b in df["keys"]], [unplanes(b).astype(np.int64) for b in df["counts"]])
        shard = int(key[0])
        _save(folder, "pair", shard, k)
        _save(folder, "pairs", shard, _small(c))
        out = [(-1, "n", b"", b"", b"", b"", b"", *(int(np.count_nonzero(c == i)) for i in (1, 2, 3, 4)))]
        context = (k >> _U(32)).astype(np.int64)
        ids, at = np.unique(context, return_index=True)
        cols = [np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c >= 3)]
        cut = np.searchsorted(ids, offsets)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[i], cut[i + 1])
            out.append((i, "context", squeeze(ids[s]), *(planes(x[s]) for x in cols), 0, 0, 0, 0))
        ids, n = np.unique((k & _U(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        cut = np.searchsorted(ids, offsets)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[i], cut[i + 1])
            out.append((i, "word", squeeze(ids[s]), planes(n[s]), b"", b"", b"", 0, 0, 0, 0))
        return pd.DataFrame(out, columns=["part", "kind", "ids", "total", "once", "twice", "more", "n1", "n2", "n3", "n4"])
    return run


def _merge_stats(folder: str, offsets: np.ndarray):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        n = int(offsets[part + 1] - offsets[part])
        context, follows = np.zeros((4, n), np.int64), np.zeros(n, np.int64)
        for r in df.itertuples():
            at = unsqueeze(r.ids).astype(np.int64) - offsets[part]
            if r.kind == "word":
                follows[at] += unplanes(r.total).astype(np.int64)
            else:
                for row, b in zip(context, (r.total, r.once, r.twice, r.more)):
                    row[at] += unplanes(b).astype(np.int64)
        _save(folder, "follows", part, _small(follows))
        for name, row in zip(("total", "once", "twice", "more"), context):
            _save(folder, name, part, _small(row))
        return pd.DataFrame({"part": [part], "all": [int(follows.sum())], "rest": [int(np.count_nonzero(follows >= 3))],
                             **{f"n{i}": [int(np.count_nonzero(follows == i))] for i in (1, 2, 3, 4)}})
    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3+ from n1..n4; where they can't be had, 0.5 each."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.1), i)) for i, d in
                 enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


# ---- the model ---------------------------------------------------------------------
class Model:
    """What a worker needs to map the files and compute probabilities."""

    def __init__(self, folder: str, bits: int, offsets: np.ndarray, tokens_: int, start: tuple[int, int]):
        self.folder, self.bits, self.offsets, self.tokens, self.start = folder, bits, offsets, tokens_, start
        self.distinct = int(offsets[-1]) - 1                # the start is no word
        self.pair_d = self.word_d = (0.5, 0.5, 0.5)
        self.pairs_all, self.word_rest = 0, 1.0
        self.pair_shards: set[int] = set()

    def opened(self) -> Model:
        m = Model(self.folder, self.bits, self.offsets, self.tokens, self.start)
        m.__dict__.update(self.__dict__)
        m.words = Words(self.folder, self.bits, self.offsets)
        m.stats = Shards(self.folder, "follows", "total", "once", "twice", "more")
        m.grams = Shards(self.folder, "pair", "pairs")
        return m

    def _by_id(self, ids: np.ndarray) -> np.ndarray:
        """(follows, total, once, twice, more) of known ids, 0 for -1."""
        u, back = np.unique(ids, return_inverse=True)
        out = np.zeros((5, u.size), np.int64)
        cut = np.searchsorted(u, self.offsets)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[i], cut[i + 1])
            for row, a in zip(out, self.stats[i]):
                row[s] = a[u[s] - self.offsets[i]]
        return out[:, back]

    def _pair_counts(self, context: np.ndarray, seen: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(ids.size, np.int64)
        there = np.flatnonzero((context >= 0) & (ids >= 0))
        if not there.size:
            return out
        shard = _shard_of(context[there], ids[there], seen[there], 1 << self.bits)
        keys = context[there].astype(np.uint64) << _U(32) | ids[there].astype(np.uint64)
        order = np.lexsort((keys, shard))
        keys, there = keys[order], there[order]
        cut = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            if i in self.pair_shards:
                k, c = self.grams[i]
                q = keys[cut[i]:cut[i + 1]]
                at = np.minimum(np.searchsorted(k, q), k.size - 1)
                out[there[cut[i]:cut[i + 1]]] = np.where(k[at] == q, c[at], 0)
        return out

    @staticmethod
    def _discounted(c: np.ndarray, d: tuple) -> np.ndarray:
        return c - np.array([0.0, *d])[np.minimum(c, 3)]

    def score(self, texts: pa.Array):
        """(tokens, known tokens, base score, score) of every text; logarithms to base 10."""
        h, bounds = tokens(texts)
        ids, count = self.words.find(h)
        context = _context(ids, bounds, self.start[0])
        seen = np.empty_like(count)
        seen[1:] = count[:-1]
        seen[bounds[:-1]] = self.start[1]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))
        follows = self._by_id(ids)[0]
        uniform = 1.0 / (self.distinct + 1)
        if self.pairs_all:
            p = self._discounted(follows, self.word_d) / self.pairs_all + self.word_rest * uniform
            _, total, once, twice, more = self._by_id(context)
            d = self.pair_d
            down = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), 1.0)
            pair = self._pair_counts(context, seen, ids)
            p = self._discounted(pair, d) / np.maximum(total, 1) + down * p
        else:
            p = np.full(ids.size, uniform)
        at = bounds[:-1]
        return (np.diff(bounds), np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at),
                np.add.reduceat(np.log10(p), at))


def _folder(spark: SparkSession) -> str:
    path = C.shared_path(spark, "kneser-ney")
    if not re.match(r"file:|/", path):
        raise ValueError(f"the model's files need a folder that all workers mount, not {path}: pass folder=")
    return re.sub(r"^file:/*", "/", path)


def train(texts: DataFrame, folder: str | None = None) -> Model:
    """The model of all rows of ``texts`` (one column, text)."""
    spark = texts.sparkSession
    C.prepared(spark)
    folder = folder or _folder(spark)
    os.makedirs(folder, exist_ok=True)
    parts = max(1, texts.rdd.getNumPartitions())
    bits = (parts * SHARDS_PER_PARTITION).bit_length()
    shards = 1 << bits

    got = (texts.mapInArrow(_word_blocks(bits), _BLOCK).groupBy("shard")
                .applyInPandas(_merge_words(folder), "shard int, n long, total long").collect())    # a row per shard
    sizes = np.zeros(shards, np.int64)
    for r in got:
        sizes[r.shard] = r.n
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = sum(r.total for r in got)
    words = Words(folder, bits, offsets)
    if offsets[-1] == 0:                                    # no input partition at all
        return Model(folder, bits, np.append(offsets[:-1], 1), 0, (-1, 0))
    if offsets[-1] >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    id_, _ = words.find(np.array([START], np.uint64))
    _, ends = words.find(np.array([END], np.uint64))
    model = Model(folder, bits, offsets, n, (int(id_[0]), int(ends[0])))    # as many starts as ends
    if n == 0:
        return model

    stats = C.scratch(texts.mapInArrow(_pair_blocks(folder, bits, offsets, model.start), _BLOCK).groupBy("shard")
                           .applyInPandas(_with_shard(_merge_pairs(folder, offsets)), _STATS + ", shard int"), "kn-stats")
    tops = stats.where("kind = 'n'").select("shard", "n1", "n2", "n3", "n4").collect()              # a row per shard
    model.pair_shards = {r.shard for r in tops}
    model.pair_d = discounts([sum(r[f"n{i}"] for r in tops) for i in (1, 2, 3, 4)])
    everyone = spark.range(shards).select(F.col("id").cast("int").alias("part"), F.lit("word").alias("kind"),
                                          *[F.lit(b"").alias(c) for c in ("ids", "total", "once", "twice", "more")])
    rows = stats.where("kind <> 'n'").select("part", "kind", "ids", "total", "once", "twice", "more")
    low = (rows.unionByName(everyone).groupBy("part")
               .applyInPandas(_merge_stats(folder, offsets),
                              "part int, all long, rest long, n1 long, n2 long, n3 long, n4 long").collect())
    model.pairs_all = sum(r["all"] for r in low)
    model.word_d = discounts([sum(r[f"n{i}"] for r in low) for i in (1, 2, 3, 4)])
    d = model.word_d
    model.word_rest = (d[0] * sum(r.n1 for r in low) + d[1] * sum(r.n2 for r in low)
                       + d[2] * sum(r.rest for r in low)) / model.pairs_all
    return model


def _with_shard(f):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return f(key, df).assign(shard=int(key[0]))
    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for batch in batches:
            for part in C.slices(batch, limit=BLOCK_BYTES):
                n, known, base, score = model.score(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(known),
                     pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    d = _folds(docs).select("doc_id", "held_out", "text")
    return d.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)),
                        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                        "base_score double, score double")


def _folds(docs: DataFrame) -> DataFrame:
    d = C.pick(docs, doc_id="long", text="string")
    return d.withColumn("held_out", C.crc_mod(F.col("doc_id"), FOLD) == 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, train(_folds(docs).where("not held_out").select("text")))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLE = {}
