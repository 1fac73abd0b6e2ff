"""Operator 12: collocations from an FM-index per shard over word ids.

1. Shards. Texts (A-Z lower-cased) are split at ``.,;:!?`` and line ends into pieces
   and these into words. A task gathers the word ids of one language, with a separator
   between pieces, into shards of about ``SHARD_WORDS`` words; a piece is never cut.
2. Words. A shard sends its words and counts in blocks to buckets by a hash of the word.
   A bucket sums them over the shards, numbers the words seen ``min_count`` times or more
   and answers each shard which of its words these are. In a shard all others become
   separators, as no frequent phrase holds them.
3. Index. Of a shard's sequence and of its reverse the Burrows-Wheeler transform is
   taken, with rotations sorted as far as ``max_words`` words (patterns are not longer).
   The interval of a phrase P in one transform and that of its reverse in the other are
   extended together: the symbols in P's interval are the words before (after) P, their
   counts the counts of the longer phrases; a rank query gives the new interval there,
   the sum over smaller symbols the one in the other transform.
4. Levels. All words are extended to the left, which gives the pairs, and pairs to the
   right up to ``max_words``. The counts of a level go through buckets like those of the
   words; a phrase stands as (number of all but its last word, number of the last word).
   Only frequent phrases are extended further, and only by a word that follows their
   last one often enough. So nothing frequent is lost, and no phrase is a row of its own
   before it is known to be frequent. Buckets follow the number of input partitions.
5. Scores. Every frequent phrase finds the numbers of its first and last words by joins
   on these numbers. It is dropped if one with a word more, to its left or right, has
   ``contained`` per cent of its count: what lies inside a longer phrase lies inside
   one that has a word more and is at least as frequent. Arithmetic is in decimals of
   38 digits; the first ``top`` of a language are cut per hash slice of the language
   first, so no task sees a whole language.

Rows: a null or empty text has no words; a null lang is ``und``; ids are not used, so
rows that repeat an id all count. An empty table gives an empty result. Texts are
handled whole, of any length; no word or phrase is capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .lm_scoring import planes, squeeze, unplanes, unsqueeze

MAX_WORDS, MIN_COUNT, CONTAINED, TOP = 3, 10, 50, 2000
SHARD_WORDS = 1 << 20
BUCKETS_PER_PARTITION = 4
SLICES = 16                      # of a language, for the first cut to ``top``
_U = np.uint64
_PLACE_BITS = 40                 # a number of a word or phrase: bucket, then its place there

_CLEAN = bytearray(range(256))
_CLEAN[65:91] = bytes(range(97, 123))
_CLEAN[9] = 0x20
for _c in b".,;:!?\n\x0b\x0c\r":
    _CLEAN[_c] = 0x0A
_CLEAN = bytes(_CLEAN)


# ---- shards ------------------------------------------------------------------------
class _Ids(dict):
    """Numbers from 1 of words as they come; 0 is the separator, -1 what lies between two blanks."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def word_ids(text: bytes, ids: _Ids) -> np.ndarray:
    words = text.translate(_CLEAN).replace(b"\n", b" \n ").split(b" ")
    a = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
    return a[a >= 0]


def _cut(seq: np.ndarray, size: int):
    """Parts of about ``size``, cut at separators."""
    zeros = np.flatnonzero(seq == 0)
    at = 0
    while at < seq.size:
        k = np.searchsorted(zeros, at + size)
        end = int(zeros[k]) + 1 if k < zeros.size else seq.size
        yield seq[at:end]
        at = end


def _packed(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def _ints(packed: bytes) -> np.ndarray:
    return unplanes(zstandard.decompress(packed)).astype(np.int64)


def _sorted_ints(packed: bytes) -> np.ndarray:
    return unsqueeze(zstandard.decompress(packed)).astype(np.int64)


def _of_ints(a: np.ndarray) -> bytes:
    return _packed(planes(a))


def _of_sorted_ints(a: np.ndarray) -> bytes:
    return _packed(squeeze(a))


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


# a row is the sequence of a shard (bucket -1) or a block of words for a bucket
_SHARD = "lang string, shard long, bucket int, size long, ids binary, words binary, counts binary"
_SHARD_TYPES = dict(zip(("lang", "shard", "bucket", "size", "ids", "words", "counts"),
                        (pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3)))


def _shards(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Ids] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def sent(lang: str):
            """The shards of a language, their words numbered in the order of buckets and then of the words."""
            nonlocal made
            words = [b"", *list(numbers.pop(lang))[2:]]
            sequence = np.concatenate(held.pop(lang))
            del sizes[lang]
            keys = sorted((zlib.crc32(w) % buckets, w, i) for i, w in enumerate(words) if i)
            order = np.array([i for _, _, i in keys], np.int64)
            bucket = np.array([b for b, _, _ in keys], np.int64)
            for part in _cut(sequence, size):
                counts = np.bincount(part, minlength=len(words))
                there = np.flatnonzero(counts[order])
                own = np.zeros(len(words), np.uint32)
                own[order[there]] = np.arange(1, there.size + 1)
                made += 1
                rows = [(lang, made, -1, int(counts[order].sum()), _of_ints(own[part]), None, None)]
                cut = np.searchsorted(bucket[there], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    some = there[cut[b]:cut[b + 1]]
                    rows.append((lang, made, b, None, None, _packed(b"\n".join([keys[i][1] for i in some.tolist()])),
                                 _of_ints(counts[order[some]])))
                yield from _table(rows, _SHARD_TYPES).to_batches()
        for batch in batches:
            for part in C.slices(batch):
                texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    a = word_ids(text + b"\n", numbers.setdefault(lang, _Ids()))
                    held.setdefault(lang, []).append(a)
                    sizes[lang] = sizes.get(lang, 0) + a.size
                # a language with enough words makes its shard; many small ones make theirs together
                full = list(sizes) if sum(sizes.values()) >= 2 * size else [x for x, n in sizes.items() if n >= size]
                for lang in full:
                    yield from sent(lang)
        for lang in list(held):
            yield from sent(lang)
    return run


_WORDS = "bucket int, shard long, places binary, lang string, words array<string>, counts array<long>"
_WORDS_TYPES = dict(zip(("bucket", "shard", "places", "lang", "words", "counts"),
                        (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))))


def _merge_words(min_count: int):
    """Sums a bucket's blocks: per language the frequent words (shard null), and for each shard the places of its words, from 1."""
    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        bucket, used, rows = key[0].as_py(), 0, []
        by_lang: dict[str, list[tuple]] = {}
        for row in zip(*[blocks.column(c).to_pylist() for c in ("lang", "shard", "words", "counts")]):
            by_lang.setdefault(row[0], []).append(row[1:])
        for lang in sorted(by_lang):
            own = [zstandard.decompress(w).split(b"\n") for _, w, _ in by_lang[lang]]
            coded = pa.array([w for x in own for w in x], pa.binary()).dictionary_encode()
            code = coded.indices.to_numpy()
            counts = np.concatenate([_ints(c) for _, _, c in by_lang[lang]])
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, code, counts)
            frequent = total >= min_count
            place = np.where(frequent, np.cumsum(frequent) + used, 0)
            rows.append((bucket, None, None, lang,
                         [w.decode("utf-8", "replace") for w in coded.dictionary.filter(pa.array(frequent)).to_pylist()], total[frequent]))
            ends = np.cumsum([len(x) for x in own])
            rows += [(bucket, s, _of_ints(x), None, None, None)
                     for (s, _, _), x in zip(by_lang[lang], np.split(place[code], ends[:-1]))]
            used += int(frequent.sum())
        C.give_back()
        return _table(rows, _WORDS_TYPES)
    return run


# ---- the index ---------------------------------------------------------------------
def rotations(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of ``s``, sorted by their first ``depth`` symbols."""
    rank, known = s.astype(np.uint64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        step = min(known, depth - known)
        key = rank << _U(32) | np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))).astype(np.uint64)
        known += step
    return order


class Transform:
    """A Burrows-Wheeler transform with rank queries by the sorted places of each symbol."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt = bwt
        self.first = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=symbols))))      # of each symbol's block
        places = np.argsort(bwt, kind="stable")
        self.places = bwt[places].astype(np.uint64) << _U(32) | places.astype(np.uint64)

    @classmethod
    def of(cls, s: np.ndarray, symbols: int, depth: int) -> Transform:
        return cls(s[rotations(s, depth) - 1], symbols)

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The start of the rows that put ``symbol`` before the rows from ``at`` on."""
        return np.searchsorted(self.places, symbol.astype(np.uint64) << _U(32) | at.astype(np.uint64))


def extend(index: Transform, here: np.ndarray, there: np.ndarray, n: np.ndarray):
    """All one-word extensions of phrases with intervals [here, here + n) in ``index`` and [there, there + n)
    in the other transform: (phrase, symbol, here, there, n) of the longer phrases."""
    phrase = np.repeat(np.arange(n.size), n)
    rows = np.arange(phrase.size) - np.repeat(np.cumsum(n) - n, n) + here[phrase]
    key, count = np.unique(phrase.astype(np.uint64) << _U(32) | index.bwt[rows].astype(np.uint64), return_counts=True)
    phrase, symbol = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
    smaller = np.cumsum(count) - count                      # rows of the phrase with a smaller symbol (separators, too)
    smaller -= smaller[np.searchsorted(phrase, phrase)]
    word = symbol > 0
    phrase, symbol, count, smaller = (x[word] for x in (phrase, symbol, count, smaller))
    return phrase, symbol, index.before(symbol, here[phrase]), there[phrase] + smaller, count


# ---- levels ------------------------------------------------------------------------
# a row is the state of a shard (bucket -1) or a block of phrases for a bucket
_LEVEL = "shard long, bucket int, state array<binary>, parents binary, lasts binary, counts binary"
_LEVEL_TYPES = dict(zip(("shard", "bucket", "state", "parents", "lasts", "counts"),
                        (pa.int64(), pa.int32(), pa.list_(pa.binary()), *[pa.binary()] * 3)))


def _rows(shard: int, state: list[bytes], buckets: int, parents: np.ndarray, lasts: np.ndarray, counts: np.ndarray) -> pa.Table:
    """The state, and the blocks of phrases that the caller has put into the order of ``_bucket_order``."""
    cut = np.searchsorted(_bucket(parents, lasts, buckets), np.arange(buckets + 1))
    rows = [(shard, -1, state, None, None, None)]
    for b in np.flatnonzero(np.diff(cut)).tolist():
        some = slice(cut[b], cut[b + 1])
        rows.append((shard, b, None, _of_sorted_ints(parents[some]), _of_ints(lasts[some]), _of_ints(counts[some])))
    return _table(rows, _LEVEL_TYPES)


def _bucket(parents: np.ndarray, lasts: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (C.mix(C.mix(parents.astype(np.uint64)) + lasts.astype(np.uint64)) % _U(buckets)).astype(np.int64)


def _bucket_order(parents: np.ndarray, lasts: np.ndarray, buckets: int) -> np.ndarray:
    return np.lexsort((lasts, parents, _bucket(parents, lasts, buckets)))


def _numbers(answers: pa.Table) -> np.ndarray:
    """The number, or -1 if it isn't frequent, of each word or phrase that a shard has sent."""
    answers = answers.sort_by("bucket")
    place = [_ints(b) for b in answers.column("places").to_pylist()]
    bucket = np.repeat(answers.column("bucket").to_numpy().astype(np.int64), [p.size for p in place])
    place = np.concatenate(place)
    return np.where(place > 0, bucket << _PLACE_BITS | place - 1, -1)


def _first_level(max_words: int, buckets: int):
    """Builds a shard's index and extends all words to the left."""
    def index(ids: np.ndarray, number: np.ndarray) -> tuple[Transform, Transform, np.ndarray]:
        own = np.flatnonzero(number >= 0)
        own = own[np.argsort(number[own])]
        symbol = np.zeros(number.size + 1, np.uint32)
        symbol[own + 1] = np.arange(1, own.size + 1)
        s = np.concatenate((np.zeros(1, np.uint32), symbol[ids], np.zeros(1, np.uint32)))
        s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]         # one separator is as good as many
        return (*[Transform.of(x, own.size + 1, max_words) for x in (s, s[::-1].copy())], np.concatenate(([-1], number[own])))

    def run(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
        if not shard.num_rows or not answers.num_rows:
            return _table([], _LEVEL_TYPES)
        left, right, numbers = index(_ints(shard.column("ids")[0].as_py()), _numbers(answers))
        n = np.diff(left.first)[1:]
        last, first, _, here, n = extend(left, left.first[1:-1], right.first[1:-1], n)
        last += 1
        order = _bucket_order(numbers[first], numbers[last], buckets)
        first, last, here, n = (x[order] for x in (first, last, here, n))
        state = [_of_ints(right.bwt), _of_sorted_ints(numbers[1:]), *map(_of_ints, (here, n, first, last))]
        del left, right
        out = _rows(key[0].as_py(), state, buckets, numbers[first], numbers[last], n)
        C.give_back()
        return out
    return run


def _next_level(level: int, buckets: int):
    """Extends the frequent phrases of a shard to the right."""
    def run(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
        if not shard.num_rows or not answers.num_rows:
            return _table([], _LEVEL_TYPES)
        state = shard.column("state")[0].as_py()
        numbers = np.concatenate(([-1], _sorted_ints(state[1])))
        right = Transform(_ints(state[0]).astype(np.uint32), numbers.size)
        here, n, first, last = map(_ints, state[2:])
        parents = _numbers(answers)
        keep = parents >= 0
        # the frequent pairs: known from the answers at the first level, handed on from then
        pairs = np.sort(first[keep] << 32 | last[keep]) if level == 3 else first
        parents, here, n, last = (x[keep] for x in (parents, here, n, last))
        phrase, word, here, _, n = extend(right, here, np.zeros_like(here), n)
        pair = last[phrase] << 32 | word
        good = pairs[np.minimum(np.searchsorted(pairs, pair), pairs.size - 1)] == pair if pairs.size else pair < 0
        phrase, word, here, n = (x[good] for x in (phrase, word, here, n))
        order = _bucket_order(parents[phrase], numbers[word], buckets)
        phrase, word, here, n = (x[order] for x in (phrase, word, here, n))
        state = [*state[:2], *map(_of_ints, (here, n, pairs, word))]
        out = _rows(key[0].as_py(), state, buckets, parents[phrase], numbers[word], n)
        C.give_back()
        return out
    return run


_MERGED = "bucket int, shard long, places binary, parents array<long>, lasts array<long>, counts array<long>"
_MERGED_TYPES = dict(zip(("bucket", "shard", "places", "parents", "lasts", "counts"),
                         (pa.int32(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)))


def _merge(min_count: int):
    """Sums a bucket's blocks: the frequent phrases (shard null), and for each shard the places of its phrases, from 1."""
    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        cols = [[f(b) for b in blocks.column(c).to_pylist()] for c, f in
                (("parents", _sorted_ints), ("lasts", _ints), ("counts", _ints))]
        parents, lasts, counts = (np.concatenate(c) for c in cols)
        order = np.lexsort((lasts, parents))
        new = np.ones(order.size, bool)
        p, w = parents[order], lasts[order]
        new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], at)
        frequent = total >= min_count
        place = np.empty(order.size, np.int64)
        place[order] = np.where(frequent, np.cumsum(frequent), 0)[np.cumsum(new) - 1]
        ends = np.cumsum([c.size for c in cols[0]])
        bucket = key[0].as_py()
        rows = [(bucket, s, _of_ints(x), None, None, None)
                for s, x in zip(blocks.column("shard").to_pylist(), np.split(place, ends[:-1]))]
        rows.append((bucket, None, None, p[at][frequent], w[at][frequent], total[frequent]))
        C.give_back()
        return _table(rows, _MERGED_TYPES)
    return run


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                     shard_words: int = SHARD_WORDS, buckets: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): all word occurrences; and by length 1 to ``max_words`` the phrases seen ``min_count`` times:
    lang, id, parent, last, tail (ids of all but the last word, the last, all but the first), words, f, and the
    counts of all shorter beginnings (``before``) and of what follows them (``after``), by length of the beginning."""
    C.prepared(docs.sparkSession)
    texts = C.pick(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    buckets = buckets or BUCKETS_PER_PARTITION * max(1, texts.rdd.getNumPartitions())
    number = lambda place: F.shiftleft(F.col("bucket").cast("long"), _PLACE_BITS) + place
    nothing = F.array().cast("array<bigint>")

    shards = C.scratch(texts.mapInArrow(C.released(_shards(shard_words, buckets)), _SHARD), "phrase-shards")
    totals = shards.where("bucket < 0").groupBy("lang").agg(F.sum("size").alias("n"))
    merged = C.scratch(shards.where("bucket >= 0").select("bucket", "lang", "shard", "words", "counts")
                             .groupBy("bucket").applyInArrow(_merge_words(min_count), _WORDS), "phrase-words")
    # of several languages in a bucket, the words of the later ones come after those of the earlier ones
    earlier = Window.partitionBy("bucket").orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    words = merged.where("shard is null").withColumn("used", F.coalesce(F.sum(F.size("words")).over(earlier), F.lit(0)))
    words = words.select("lang", "bucket", "used", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
    levels = [C.scratch(words.select("lang", number(F.col("used") + F.col("pos")).alias("id"), F.array("w.words").alias("words"),
                                     F.col("w.counts").alias("f"), nothing.alias("before"), nothing.alias("after")), "phrase-grams")]
    answered = lambda m: m.where("shard is not null").select("shard", "bucket", "places").groupBy("shard")
    state = C.scratch(shards.where("bucket < 0").select("shard", "ids").groupBy("shard").cogroup(answered(merged))
                            .applyInArrow(_first_level(max_words, buckets), _LEVEL), "phrase-level")
    for level in range(2, max_words + 1):
        merged = C.scratch(state.where("bucket >= 0").select("bucket", "shard", "parents", "lasts", "counts")
                                .groupBy("bucket").applyInArrow(_merge(min_count), _MERGED), "phrase-merged")
        sums = merged.where("shard is null").select("bucket", F.posexplode(F.arrays_zip("parents", "lasts", "counts")).alias("pos", "x"))
        sums = sums.select(number(F.col("pos")).alias("id"), F.col("x.parents").alias("parent"), F.col("x.lasts").alias("last"),
                           F.col("x.counts").alias("f"))
        levels.append(C.scratch(_linked(sums, levels), "phrase-grams"))
        if level < max_words:
            state = C.scratch(state.where("bucket < 0").select("shard", "state").groupBy("shard").cogroup(answered(merged))
                                   .applyInArrow(_next_level(level + 1, buckets), _LEVEL), "phrase-level")
    return totals, levels


def _linked(sums: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Phrases with the words and counts of their parts: the beginning by its id, the ending by its own parts."""
    begin = levels[-1].select(F.col("id").alias("parent"), "lang", F.col("words").alias("w"), F.col("f").alias("fb"),
                              F.col("before").alias("b"), *([F.col("tail").alias("t")] if len(levels) > 1 else []))
    g = sums.join(begin, "parent")
    end = levels[-1].select(F.col("id").alias("tail"), F.element_at("words", -1).alias("word"), F.col("f").alias("fe"),
                            F.col("after").alias("e"), *([F.col("parent").alias("t"), "last"] if len(levels) > 1 else []))
    g = g.join(end, ["t", "last"]) if len(levels) > 1 else g.join(end, F.col("last") == F.col("tail"))
    return g.select("lang", "id", "parent", "last", "tail", F.concat("w", F.array("word")).alias("words"), "f",
                    F.concat("b", F.array("fb")).alias("before"), F.concat(F.array("fe"), "e").alias("after"))


# ---- scores ------------------------------------------------------------------------
def _score(words: int) -> Column:
    """The lowest (score, k, l, r) of all cuts after k words."""
    a = F.col("f").cast("decimal(20,0)")
    cuts = []
    for k in range(1, words):
        l, r = F.col("before")[k - 1], F.col("after")[k - 1]  # noqa: E741
        whole = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a),
                                l.cast("decimal(19,0)") * r.cast("decimal(19,0)"))
        cuts.append(F.struct(whole.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return cuts[0] if len(cuts) == 1 else F.least(*cuts)


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, contained: int = CONTAINED,
                 top: int = TOP, **sizes) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = frequent_phrases(docs, max_words, min_count, **sizes)
    found = None
    for m in range(2, max_words + 1):
        rows = levels[m - 1]
        if m < max_words:
            longer = levels[m].select(F.explode(F.array("parent", "tail")).alias("id"), "f")
            longer = longer.groupBy("id").agg(F.max("f").alias("most"))
            rows = rows.join(longer, "id", "left").where(f"most is null or 100 * most < {contained} * f")
        rows = rows.withColumn("cut", _score(m)).select(
            "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", "slice").orderBy(*order)
    rank = Window.partitionBy("lang").orderBy(*order)
    return (found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
                 .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
                 .withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= top)
                 .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.documents(spark, sf_dir))


QUERIES = {"op12_phrase_mining": op12_phrase_mining}
ORACLE = {"op12_phrase_mining": r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, text FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS text FROM documents)),
listed AS (SELECT lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM pieces),
w AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS nth FROM listed),
tri AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY piece ORDER BY nth)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM tri WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM tri WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1
          JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2
          JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (
  SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT ranked.lang, rank, phrase, a, l, r, n.n AS n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""}
