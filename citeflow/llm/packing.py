"""Operator 5: best-two-fit packing of tokenised documents into fixed-length sequences.

1. Tokens. Whole texts are tokenised in Arrow batches; a worker keeps a bounded
   cache from white-space-separated words to ids (the tokenizer drops white space
   and never merges across it). A document is its ids and then END; documents
   longer than ``capacity`` are cut into pieces of that length. The pieces go to
   the shared folder with their place among the equal lengths of their task.
2. Plan. Only the length histogram matters: at most ``capacity`` numbers, whatever
   the number of documents. A sequence is opened with the longest length left and
   filled greedily with the longest that fits; then its smallest document is
   replaced by two unpacked ones if these fill the expanded gap more tightly. The
   pattern is repeated as often as the counts allow, so the plan has a few rows
   per distinct length.
3. Places. A piece's rank among all pieces of its length is its place in its task
   plus the earlier tasks' counts (a join on task and length); the plan, a few
   arrays bounded by the number of lengths, is broadcast and turns (length, rank)
   into sequence and offset. No group of equal lengths meets in one task.

Rows: a null text is empty and gives the piece [END]. Null ids and rows that
repeat an id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
END = 1
CACHE_WORDS = 350_000       # about 200 bytes each; an idle worker keeps them
STAGE_CACHE_WORDS = 150_000
MET = 1 << 21               # bytes that mark words met before
BLOCK_BYTES = 2 << 20       # text tokenised at once: new words are encoded once per block
WORD_END, RUN = "</w>", 2000     # the mark of a word's last id in the vocabulary; words per text
_STOPS = frozenset(".,;:!?")
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts as bytes (little-endian, 4 bytes an id), by a bounded cache of words.

    The cache takes all words until it is half full, and then those that an earlier block
    had, too (marked by a hash; one taken for another does no harm), so that words that
    occur once don't fill it. It outlives a task as the worker does. ASCII letters are
    lower-cased first, as the (lower-casing) tokenizer does itself.
    """

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        self.met = bytearray(MET)

    def _encoded(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(g.ids, "<u4").tobytes() for g in got]

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words. Words of letters, or letters and one stop, are encoded many in one text:
        the tokenizer makes one and two parts of them, and the last id of a part is marked in the vocabulary."""
        texts = [w.decode("utf-8", "replace") for w in words]
        parts = [_parts(t) if self.ends_word.any() else 0 for t in texts]
        plain = [k for k, n in enumerate(parts) if n]
        runs = [plain[a:a + RUN] for a in range(0, len(plain), RUN)]
        other = [k for k, n in enumerate(parts) if not n]
        for some, raw in zip(runs, self._encoded([" ".join([texts[k] for k in some]) for some in runs])):
            ends = np.flatnonzero(self.ends_word[np.frombuffer(raw, "<u4")]) + 1
            last = np.cumsum([parts[k] for k in some])
            if ends.size != last[-1]:                       # not as foreseen: one by one
                other += some
                continue
            ends = (4 * ends[last - 1]).tolist()
            self.cache.update((words[k], raw[x:y]) for k, x, y in zip(some, [0, *ends[:-1]], ends))
        self.cache.update(zip([words[k] for k in other], self._encoded([texts[k] for k in other])))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [(t.lower() if _lowers(t) else t).split() for t in texts]
        new = list(set().union(*words) - self.cache.keys()) if words else []
        self._learn(new)
        find = self.cache.__getitem__
        out = [b"".join(map(find, w)) for w in words]
        room = self.cache_words - len(self.cache) + len(new)
        if len(self.cache) > self.cache_words // 2:
            for w in new:
                at = hash(w) & MET - 1
                if self.met[at] and room > 0:
                    room -= 1
                else:
                    self.met[at] = 1
                    del self.cache[w]
        return out


def _lowers(text: bytes) -> bool:
    """Whether lower-casing ASCII letters first leaves the ids as they are: the tokenizer looks for special
    tokens before, and composes letters with combining marks (U+0300 to U+036F) before."""
    return not (b"\xcc" in text or b"\xcd" in text or b"<|" in text)


def _parts(word: str) -> int:
    """1 for letters, 2 for letters and a stop, else 0 (also where lower case is no letter)."""
    stop = word[-1:] in _STOPS
    return (1 + stop) if (word[:-1] if stop else word).isalpha() and word.lower()[:len(word) - stop].isalpha() else 0


def word_ids(vocabulary: str, cache_words: int) -> WordIds:
    """The worker's own encoder."""
    return C.kept(("word ids", vocabulary, cache_words), lambda: WordIds(vocabulary, cache_words))


def _pieces(vocabulary: str, capacity: int, end: int, cache_words: int = CACHE_WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary, cache_words)
        tail = np.asarray([end], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        size = 4 * capacity
        for batch in batches:
            for part in C.slices(batch, limit=BLOCK_BYTES):
                texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                out = ([], [], [], [], [], [])
                for doc, raw in zip(part.column(0).to_pylist(), ids_of(texts)):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), size)):
                        own = raw[at:at + size]
                        n = len(own) // 4
                        for c, v in zip(out, (doc, k, at // 4, n, zlib.crc32(own), seen[n])):
                            c.append(v)
                        seen[n] += 1
                n = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]],
                     pa.array(np.full(n, task, np.int32)), pa.array(out[5], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])
    return run


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """The packing of ``counts[n]`` pieces of each length n, as segments of equal lengths.

    A segment says: the pieces of ``length`` with rank ``first`` and on go, ``each``
    to a sequence, to sequence ``base`` and on, at ``offset`` in it.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros_like(left)
    segments: list[tuple[int, int, int, int, int]] = []
    base = 0

    def longest(fits: int) -> int:
        some = np.flatnonzero(left[:fits + 1])
        return int(some[-1]) if some.size else 0

    def two(fits: int, beat: int) -> tuple[int, int]:
        """Two lengths left whose sum is largest within ``fits`` and above ``beat``; (0, 0) if none."""
        have = np.flatnonzero(left[:fits + 1])
        if not have.size:
            return 0, 0
        below = np.zeros(fits + 1, np.int64)
        below[have] = have
        np.maximum.accumulate(below, out=below)
        mate = below[fits - have]
        single = (mate == have) & (left[have] < 2)
        mate[single] = below[np.maximum(mate[single] - 1, 0)]
        total = np.where(mate > 0, have + mate, 0)
        best = int(total.argmax())
        return (int(have[best]), int(mate[best])) if total[best] > beat else (0, 0)

    while left.any():
        items: list[int] = []
        gap = capacity
        while gap and (x := longest(gap)):
            items.append(x)
            left[x] -= 1
            gap -= x
        if gap and len(items) > 1:
            x, y = two(gap + items[-1], items[-1])
            if x:
                left[items.pop()] += 1
                for z in (x, y):
                    items.append(z)
                    left[z] -= 1
        kinds, each = np.unique(items, return_counts=True)
        more = int((left[kinds] // each).min())         # the same pattern again, as often as it can be had
        left[kinds] -= more * each
        at = 0
        for n, k in zip(kinds[::-1].tolist(), each[::-1].tolist()):
            segments.append((n, int(used[n]), base, k, at))
            used[n] += k * (more + 1)
            at += n * k
        base += more + 1
    segments.sort()
    cols = np.array(segments, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "each", "offset"), cols)) | {"sequences": np.array([base])}


_RANK_BITS = 44          # a length and a rank in one sortable number


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p["length"] << _RANK_BITS) | p["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            s = np.searchsorted(keys, (length << _RANK_BITS) | rank, "right") - 1
            nth = rank - p["first"][s]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(p["base"][s] + nth // p["each"][s]),
                 pa.array(p["offset"][s] + nth % p["each"][s] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END,
         cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    C.prepared(spark)
    docs = C.pick(docs, doc_id="long", text="string")
    pieces = C.scratch(docs.mapInArrow(C.released(_pieces(vocabulary or default_vocabulary(), capacity, end, cache_words), keeps=True), PIECE_SCHEMA),
                       "pack-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():         # at most ``capacity`` rows
        counts[n] = c
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    ranked = pieces.join(offsets.select("length", "task", "earlier"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                              "sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the pieces of ``docs`` with their sequences. Its workers serve the other
    stages, too, so their cache is smaller."""
    return pack(docs, cache_words=STAGE_CACHE_WORDS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))


QUERIES = {"op5_packing": op5_packing}
ORACLE = {}
