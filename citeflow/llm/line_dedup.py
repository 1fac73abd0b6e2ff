"""Operator 11: line deduplication by a sharded minimal perfect hash.

* Key of a line: the line without white space at its ends, A-Z lower-cased; keys of
  fewer than ``min_chars`` code points are left alone. Keys stand as 128-bit hashes.
* Count. Each task adds up its own documents (a key counts once a document, with the
  largest id holding it) and sends sorted blocks to the shard of the hash, so a line
  that is in every document is one row per task.
* Index. A shard merges its blocks and builds a minimal perfect hash over its distinct
  line hashes: a cascade of bit arrays, where a hash that is alone on its place takes
  the bit and the others go on to the next array; the rank of a hash's bit is its slot.
  By slot lie a 32-bit fingerprint and the number of documents, in the smallest integer
  type that holds the shard's counts; the slots of repeated lines and their largest id
  are two more sorted arrays. About 5.5 bytes a distinct line, one file a shard.
* Probe. Documents are read again in blocks; the hashes of a block's lines, sorted, are
  looked up shard by shard in the mapped arrays. No line is joined or shuffled. A line
  whose key is in ``min_docs`` documents or more goes, except in the largest id holding it.

The files lie in a folder that all workers mount (``spark.checkpoint.dir`` as a path
or file: address, anything else is an error); a task that is run again writes the same
file. Shards follow the number of input partitions.

Rows: a null or empty text is one empty line and stays so. Every row is a document, also
where ids repeat; all rows of the largest id keep their lines. A null id counts as the
smallest possible. A document that loses all its lines has an empty text. An empty table
gives an empty result. No line or document is capped; texts are handled whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS, MIN_CHARS = 3, 20
SHARDS_PER_PARTITION = 4
ROOM = 2                         # places per hash in each array of the cascade
FLUSH = 1 << 19                  # (line, document) pairs that a task gathers before it sends blocks
BLOCK_BYTES = 4 << 20            # text probed at once
NO_ID = -1 << 63
_SPACES = b" \t\n\x0b\x0c\r"
_U = np.uint64


# ---- line hashes -------------------------------------------------------------------
def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for the key of a line, or None where it is too short."""
    key = line.strip(_SPACES).lower()               # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _halves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False)


def _summed(h1, h2, count, holder):
    """One row per hash, sorted: the sum of the counts and the largest holder."""
    order = np.lexsort((h2, h1))
    h1, h2, count, holder = (x[order] for x in (h1, h2, count, holder))
    if not h1.size:
        return h1, h2, count, holder
    first = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
    return h1[first], h2[first], np.add.reduceat(count, first), np.maximum.reduceat(holder, first)


def _cuts(h1: np.ndarray, bits: int) -> np.ndarray:
    """Where the 2^bits shards begin among sorted hashes (one more place at the end)."""
    starts = np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(h1, starts), h1.size)


_BLOCK = "shard int, hashes binary, counts binary, holders binary"


def _blocks(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: list[bytes] = []
        ids: list[np.ndarray] = []
        held = 0

        def sent():
            h1, h2 = _halves(b"".join(raw))
            h1, h2, count, holder = _summed(h1, h2, np.ones(h1.size, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.int64))
            cut = _cuts(h1, bits)
            rows = [(i, np.stack((h1[a:b], h2[a:b]), 1).tobytes(), count[a:b].tobytes(), holder[a:b].tobytes())
                    for i in np.flatnonzero(np.diff(cut)).tolist() for a, b in [cut[i:i + 2]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), *[pa.binary()] * 3))],
                names=["shard", "hashes", "counts", "holders"])
        for batch in batches:
            for part in C.slices(batch):
                for doc, text in zip(_ids(part.column(0)).tolist(), _texts(part.column(1))):
                    own = {line_hash(line, min_chars) for line in set(text.split(b"\n"))}
                    own.discard(None)
                    raw += own
                    ids.append(np.full(len(own), doc, np.int64))
                    held += len(own)
                if held >= FLUSH:
                    yield from sent()
                    raw, ids, held = [], [], 0
        yield from sent()
    return run


# ---- the minimal perfect hash ------------------------------------------------------
def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (C.mix(C.mix(h1 + _U(level + 1) * C.GOLDEN) ^ h2) % _U(size)).astype(np.int64)


def fingerprints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (C.mix(h2 * C.GOLDEN ^ C.mix(h1)) >> _U(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0..n-1 of n distinct hashes: ``sizes`` (bits per array), ``words`` (all bits), ``ranks`` (per 4 words)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while h1.size:
            size = -(-ROOM * h1.size // 256) * 256
            at = _place(h1, h2, len(sizes), size)
            seen = np.bincount(at, minlength=size)
            alone = seen[at] == 1
            words.append(np.packbits(seen == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            h1, h2 = h1[~alone], h2[~alone]
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).reshape(-1, 4).sum(1, dtype=np.int64)
        return cls(np.array(sizes, np.int64), words, np.concatenate(([0], np.cumsum(ones))).astype(np.int64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each hash; a hash that was not built in has any slot or -1."""
        out = np.full(h1.size, -1, np.int64)
        left, base = np.arange(h1.size), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not left.size:
                break
            bit = base + _place(h1[left], h2[left], level, size)
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> low & _U(1)).astype(bool)
            word, low = word[hit], low[hit]
            rank = self.ranks[word >> 2] + np.bitwise_count(self.words[word] & ((_U(1) << low) - _U(1)))
            for k in range(3):                      # whole words of the block before this one
                rank += np.where(word & 3 > k, np.bitwise_count(self.words[(word >> 2 << 2) + k]), 0)
            out[left[hit]] = rank
            left, base = left[~hit], base + size
        return out


# ---- shards as files ---------------------------------------------------------------
_PARTS = ("sizes", "words", "ranks", "prints", "counts", "repeated", "holders")


def _path(folder: str, shard: int) -> str:
    return os.path.join(folder, f"lines-{shard:07d}")


def _save(path: str, arrays: tuple[np.ndarray, ...]) -> None:
    """All arrays in one file, each in npy format and at a multiple of 64 bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        for a in arrays:
            np.lib.format.write_array(f, a)
            f.write(bytes(-f.tell() % 64))
    os.replace(part, path)


def _map(path: str) -> list[np.ndarray]:
    out = []
    with open(path, "rb") as f:
        for _ in _PARTS:
            np.lib.format.read_magic(f)
            shape, _, kind = np.lib.format.read_array_header_1_0(f)
            at, size = f.tell(), kind.itemsize * shape[0]
            out.append(np.memmap(f, kind, "r", at, shape) if size else np.zeros(0, kind))
            f.seek(-(-(at + size) // 64) * 64)
    return out


class Shard:
    def __init__(self, sizes, words, ranks, prints, counts, repeated, holders):
        self.hash = PerfectHash(sizes, words, ranks)
        self.prints, self.counts, self.repeated, self.holders = prints, counts, repeated, holders

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest id) of each line hash; (0, NO_ID) where it isn't known, NO_ID where one document has it."""
        slot = self.hash.slots(h1, h2)
        there = np.flatnonzero(slot >= 0)
        there = there[self.prints[slot[there]] == fingerprints(h1[there], h2[there])]
        count, holder = np.zeros(h1.size, np.int64), np.full(h1.size, NO_ID)
        count[there] = self.counts[slot[there]]
        more = np.flatnonzero(count > 1)
        holder[more] = self.holders[np.searchsorted(self.repeated, slot[more])]
        return count, holder


def _build(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        cols = [table.column(c).to_pylist() for c in ("hashes", "counts", "holders")]
        h1, h2 = _halves(b"".join(cols[0]))
        h1, h2, count, holder = _summed(h1, h2, *(np.frombuffer(b"".join(c), np.int64) for c in cols[1:]))
        index = PerfectHash.build(h1, h2)
        slot = index.slots(h1, h2)
        prints, counts = np.empty(h1.size, np.uint32), np.empty(h1.size, np.min_scalar_type(int(count.max(initial=0))))
        prints[slot], counts[slot] = fingerprints(h1, h2), count
        order = np.argsort(slot[count > 1])
        _save(_path(folder, shard), (index.sizes, index.words, index.ranks, prints, counts, slot[count > 1][order],
                                     holder[count > 1][order]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "lines": pa.array([h1.size], pa.int64())})
    return run


class Index:
    """Where the shards' files lie, and which there are."""

    def __init__(self, folder: str, bits: int, shards: set[int], min_chars: int):
        self.folder, self.bits, self.shards, self.min_chars = folder, bits, shards, min_chars
        self.open: dict[int, Shard] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest id) of each line hash, probed shard by shard."""
        count, holder = np.zeros(h1.size, np.int64), np.full(h1.size, NO_ID)
        order = np.argsort(h1)
        a, b = h1[order], h2[order]
        cut = _cuts(a, self.bits)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            if i in self.shards:
                if i not in self.open:
                    self.open[i] = Shard(*_map(_path(self.folder, i)))
                some = slice(cut[i], cut[i + 1])
                count[order[some]], holder[order[some]] = self.open[i].find(a[some], b[some])
        return count, holder


def _folder(spark: SparkSession) -> str:
    path = C.shared_path(spark, "line-index")
    if not re.match(r"file:|/", path):
        raise ValueError(f"the index files need a folder that all workers mount, not {path}: pass folder=")
    return re.sub(r"^file:/*", "/", path)


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, folder: str | None = None) -> Index:
    """The index of all lines of ``docs``."""
    spark = docs.sparkSession
    C.prepared(spark)
    folder = folder or _folder(spark)
    os.makedirs(folder, exist_ok=True)
    d = C.pick(docs, doc_id="long", text="string")
    bits = (max(1, d.rdd.getNumPartitions()) * SHARDS_PER_PARTITION - 1).bit_length()
    built = (d.mapInArrow(C.released(_blocks(bits, min_chars)), _BLOCK).groupBy("shard")
              .applyInArrow(_build(folder), "shard int, lines long").collect())          # a row per shard
    return Index(folder, bits, {r.shard for r in built}, min_chars)


# ---- probing -----------------------------------------------------------------------
def _probed(shared, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part in C.slices(batch, limit=BLOCK_BYTES):
                ids = _ids(part.column(0))
                lines = [t.split(b"\n") for t in _texts(part.column(1))]
                n = np.array([len(x) for x in lines])
                hashes = [line_hash(line, index.min_chars) for x in lines for line in x]
                there = np.flatnonzero([h is not None for h in hashes])
                count, holder = index.find(*_halves(b"".join([hashes[i] for i in there])))
                gone = np.zeros(len(hashes), bool)
                gone[there] = (count >= min_docs) & (holder != np.repeat(ids, n)[there])
                ends = np.cumsum(n)
                dropped = np.add.reduceat(gone.astype(np.int64), ends - n)
                for i in np.flatnonzero(dropped).tolist():
                    lines[i] = [x for x, g in zip(lines[i], gone[ends[i] - n[i]:ends[i]].tolist()) if not g]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(dropped),
                     pa.array([b"\n".join(x) for x in lines], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_lines", "n_dropped", "text"])
    return run


def drop_lines(docs: DataFrame, index: Index, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, text (the lines that stay)."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    C.prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)        # a folder name and the shards' numbers
    return C.pick(docs, doc_id="long", text="string").mapInArrow(
        C.released(_probed(shared, min_docs)), "doc_id long, n_lines long, n_dropped long, text string")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    return drop_lines(docs, build_index(docs, min_chars), min_docs)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(C.documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLE = {"op11_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS nth FROM d),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (
  SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.holder AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""}
