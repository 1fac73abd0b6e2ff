"""Operator 2: language identification by interpolated Kneser-Ney character models.

* Text. Lower-cased letters; every run of other characters is one space. Each
  text starts with ORDER - 1 marks that are never predicted.
* Model. Per language, n-grams of 1 to ORDER characters from a bounded sample
  (``sample`` rows of each language, the first by a hash of the id; more than
  ``languages`` languages are an error). The
  highest order uses counts, lower orders continuation counts, each with its own
  absolute discount, interpolated down to a uniform distribution. All languages
  share one sorted array of 64-bit n-gram hashes per order; a matrix beside it
  holds every language's finished log probability, and a second one the weight that
  a context passes down. The tables are bounded by the sample and broadcast.
* Prediction. The language with the lowest cross-entropy per character.
* Rejection, calibrated on a second sample: a text is accepted if its cross-entropy
  is at most ``limit`` of its language, plus Z deviations of a mean over its
  characters (which matters for short texts only). The limit lies twice as far
  above the language's median as the 99.9 % quantile of its own documents, and at
  least as far as text of the other known languages: documents in two known
  languages stay, text in an unknown one goes.

Rows: ``und`` and score 0 if the text is null or has no letter; such rows are not
accepted. Null ids count as the empty text for the fold. Rows that repeat an id
are scored one by one, and each is a row of the sample. Without any labelled text
(or without a column ``text``) every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
SAMPLE = 400                # documents of a language to learn from, and as many to calibrate on
MAX_LANGUAGES = 200         # bounds the sample: at most this many languages x 2 x SAMPLE rows, an error beyond
Z = 6.0
SLICE = 1 << 18             # bytes of text scored at once (about 60 bytes of arrays for each)
CERTAIN = 20                # characters of evidence that the score weighs
UND = "und"
_SPACE, _MARK = 0x20, 0
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, letters): all texts one after the other, with order - 1 marks before each."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    n = len(lower)
    data, off = C.buffer(lower)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(data.size + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    ends = lead[off]                                            # text bounds in characters
    letter = _is_letter()[cp]
    s = np.where(letter, cp, _SPACE).astype(np.uint32)
    first = np.zeros(cp.size + 1, bool)
    first[ends] = True
    keep = letter.copy()
    keep[1:] |= (letter[:-1] | first[1:-1])
    if keep.size:
        keep[0] = True
    count = np.zeros(cp.size + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    at = count[ends]                                            # text bounds after runs are joined
    pad = order - 1
    out = np.zeros(int(at[-1]) + n * pad, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(int(at[-1])) + (doc + 1) * pad] = s[keep]
    total = np.zeros(cp.size + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    return out, at[:-1] + np.arange(n) * pad, np.diff(total[ends])


def gram_keys(s: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n symbols that end at each position."""
    keys = []
    with np.errstate(over="ignore"):
        back = np.zeros(s.size, np.uint64)
        for n in range(order):
            prev = np.zeros(s.size, np.uint64)
            prev[n:] = s[:s.size - n]
            back = back + C.mix((prev + np.uint64(1)) * C.GOLDEN + np.uint64(n + 1))
            keys.append(C.mix(back + np.uint64(n + 1)))
    return keys


# ---- training ----------------------------------------------------------------------
def _counts(order: int):
    """Rows (lang, n, gram, shorter, context, count); shorter drops the first symbol, context the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                rows = pa.array([i for i, x in enumerate(langs) if x == lang])
                for part in C.slices(pa.RecordBatch.from_arrays([batch.column(1).take(rows)], names=["text"]), limit=SLICE):
                    s, _, _ = symbols(part.column(0), order)
                    keys = gram_keys(s, order)
                    for n in range(1, order + 1):
                        there = np.flatnonzero(s != _MARK)
                        gram = keys[n - 1][there]
                        shorter = keys[n - 2][there] if n > 1 else np.zeros(there.size, np.uint64)
                        context = keys[n - 2][there - 1] if n > 1 else np.zeros(there.size, np.uint64)
                        u, i, c = np.unique(gram, return_index=True, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * u.size, pa.string()), pa.array(np.full(u.size, n, np.int32)),
                             pa.array(u.view(np.int64)), pa.array(shorter[i].view(np.int64)),
                             pa.array(context[i].view(np.int64)), pa.array(c.astype(np.int64))],
                            names=["lang", "n", "gram", "shorter", "context", "count"])
    return run


class Model:
    """Sorted hash arrays with the languages' log probabilities, for all orders."""

    def __init__(self, langs: list[str], counts, order: int):
        self.langs, self.order = langs, order
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.ctx: list[np.ndarray] = []
        self.down: list[np.ndarray] = []
        grams = counts.drop_duplicates(["n", "gram"])
        parts = {n: grams[grams.n == n].sort_values("gram", key=lambda v: v.to_numpy().view(np.uint64))
                 for n in range(1, order + 1)}
        below = None                                        # probabilities of the next lower order
        for n in range(1, order + 1):
            keys = parts[n].gram.to_numpy().view(np.uint64)
            context = parts[n].context.to_numpy().view(np.uint64)
            shorter = parts[n].shorter.to_numpy().view(np.uint64)
            ctx, of = np.unique(context, return_inverse=True)
            p, down = np.zeros((keys.size, len(langs))), np.zeros((ctx.size, len(langs)))
            for j, lang in enumerate(langs):
                c = self._level(counts[counts.lang == lang], n, keys, order)
                n1, n2 = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                total = np.bincount(of, c, ctx.size)
                kinds = np.bincount(of, c > 0, ctx.size)
                gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                low = 1.0 / (keys.size + 1) if n == 1 else below[np.searchsorted(self.keys[-1], shorter), j]
                p[:, j] = np.maximum(c - d, 0) / np.maximum(total, 1)[of] + gamma[of] * low
                down[:, j] = gamma
            self.keys.append(keys)
            self.ctx.append(ctx)
            self.logp.append(np.log(p).astype(np.float32))
            self.down.append(np.log(down).astype(np.float32))
            below = p
        self.unseen = self.down[0][0] - np.float32(np.log(self.keys[0].size + 1.0)) if len(self.keys[0]) else None
        self.limit = np.full(len(langs), 4.0)
        self.within = np.full(len(langs), 4.0)

    @staticmethod
    def _level(own, n: int, keys: np.ndarray, order: int) -> np.ndarray:
        """Counts at the highest order; below it, of how many different symbols a gram follows."""
        out = np.zeros(keys.size)
        if n == order:
            rows = own[own.n == n]
            k, v = rows.gram.to_numpy().view(np.uint64), rows["count"].to_numpy()
        else:
            rows = own[own.n == n + 1]
            k, v = np.unique(rows.shorter.to_numpy().view(np.uint64), return_counts=True)
        out[np.searchsorted(keys, k)] = v
        return out

    def scores(self, texts: pa.Array, squares: bool = False) -> tuple[np.ndarray, ...]:
        """(cross-entropy per symbol [texts x languages], symbols, letters[, mean squares]): natural logarithms."""
        s, starts, letters = symbols(texts, self.order)
        n = len(texts)
        if s.size == 0:
            none = np.zeros((n, len(self.langs)))
            return (none, np.zeros(n), letters, none) if squares else (none, np.zeros(n), letters)
        keys = gram_keys(s, self.order)
        value = np.zeros((s.size, len(self.langs)), np.float32)
        todo = np.flatnonzero(s != _MARK)
        real = todo
        for k in range(self.order - 1, -1, -1):
            table = self.keys[k]
            q = keys[k][todo]
            at = np.minimum(np.searchsorted(table, q), table.size - 1)
            hit = table[at] == q
            value[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not todo.size:
                break
            if k:                                           # hand the context's weight down
                ctx = self.ctx[k]
                q = keys[k - 1][todo - 1]
                at = np.minimum(np.searchsorted(ctx, q), ctx.size - 1)
                hit = ctx[at] == q
                value[todo[hit]] += self.down[k][at[hit]]
            else:
                value[todo] += self.unseen
        marks = np.zeros(s.size + 1, np.int64)
        np.cumsum(s != _MARK, out=marks[1:])
        bounds = np.append(starts, s.size)
        size = marks[bounds[1:]] - marks[bounds[:-1]]
        mean = lambda v: self._sums(v, bounds) / np.maximum(size, 1)[:, None]
        return (-mean(value), size, letters, mean(value ** 2)) if squares else (-mean(value), size, letters)

    @staticmethod
    def _sums(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value, bounds[:-1], axis=0, dtype=np.float64)

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, accepted) of every text."""
        n = len(texts)
        if not self.langs:
            return [UND] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
        h, size, letters = self.scores(texts)
        best = h.argmin(axis=1)
        row = np.arange(n)
        low = h[row, best]
        odds = np.exp(-CERTAIN * (h - low[:, None]))
        known = letters > 0
        score = np.where(known, 1 / odds.sum(axis=1), 0.0)
        accepted = known & (low <= self.limit[best] + Z * np.sqrt(self.within[best] / np.maximum(size, 1)))
        return [self.langs[b] if k else UND for b, k in zip(best, known)], score, np.where(known, low, 0.0), accepted

    def calibrate(self, langs: list[str], texts: pa.Array) -> None:
        parts = [self.scores(p.column(0), squares=True)
                 for p in C.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), limit=SLICE)]
        h, size, letters, squares = (np.concatenate(x) for x in zip(*parts))
        for j, lang in enumerate(self.langs):
            own = np.array([x == lang for x in langs]) & (letters > 0)
            if not own.any():
                continue
            self.within[j] = np.average(squares[own, j] - h[own, j] ** 2, weights=size[own])
            middle = np.median(h[own, j])
            far = 2 * (np.quantile(h[own, j], 0.999) - middle)
            other = np.delete(h[own], j, axis=1)
            if other.size:
                far = max(far, np.median(other.min(axis=1)) - middle)
            self.limit[j] = middle + max(far, 0.5)


def _sample(d: DataFrame, rows: int, languages: int) -> DataFrame:
    """(lang, text, nth): the first ``rows`` rows of each language by a hash of the id, then of the text."""
    ids = d.where((C.crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()).select(
        "doc_id", "lang", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"))
    found = [r.lang for r in ids.select("lang").distinct().limit(languages + 1).collect()]
    if len(found) > languages:
        raise ValueError(f"more than {languages} values of lang: pass languages=")

    def first(df: DataFrame, keys: list, *order) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= rows)
    # a language is ranked by parts of the order first, so no task meets more than 256 x rows of its ids
    part = first(ids.withColumn("part", F.substring("turn", 1, 2)), ["lang", "part"], "turn", "doc_id")
    chosen = (first(part, ["lang"], "turn", "doc_id").groupBy("lang", "doc_id").agg(F.min("nth").alias("turn"))
              .select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "turn"))
    # at most languages x rows ids, so the broadcast is bounded; ids may repeat, so their rows are ranked again
    texts = d.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")))
    return first(texts.withColumn("sha", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), ["lang"], "turn", "sha") \
        .select("lang", "text", "nth")


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE, languages: int = MAX_LANGUAGES) -> Model:
    """Learns from text and non-null lang of the documents whose crc32 of the id, mod 3, is not 1."""
    C.prepared(docs.sparkSession)
    d = C.pick(docs, doc_id="long", lang="string", text="string")
    texts = C.scratch(_sample(d, 2 * sample, languages), "lid-sample")
    learn = texts.where(F.col("nth") % 2 == 1).select("lang", "text")
    counts = (learn.mapInArrow(_counts(order), "lang string, n int, gram long, shorter long, context long, count long")
                   .groupBy("lang", "n", "gram").agg(F.first("shorter").alias("shorter"),
                                                     F.first("context").alias("context"), F.sum("count").alias("count"))
                   .toPandas())                             # bounded by the sample
    model = Model(sorted(set(counts.lang)), counts, order)
    if model.langs:
        held = texts.where((F.col("nth") % 2 == 0) & F.col("text").isNotNull()).select("lang", "text").toArrow()
        if held.num_rows:
            held = held.combine_chunks()
            model.calibrate(held.column(0).to_pylist(), held.column(1).combine_chunks())
    return model


# ---- prediction --------------------------------------------------------------------
def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in C.slices(batch, limit=SLICE):
                lang, score, h, ok = model.decide(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(ok)],
                    names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cross_entropy, accepted."""
    spark = docs.sparkSession
    C.prepared(spark)
    d = C.pick(docs, doc_id="long", text="string").select(
        "doc_id", (C.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return d.mapInArrow(C.released(_predict(spark.sparkContext.broadcast(model))),
                        "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")


def _accepted(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in C.slices(batch, limit=SLICE):
                texts = part.column(at)
                yield part.filter(pa.array(model.decide(texts)[3]))
    return run


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose language is accepted, all columns as they are (none without a column text)."""
    if "text" not in docs.columns:
        return docs.where(F.lit(False))
    shared = spark.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(C.released(_accepted(shared, docs.columns.index("text"))), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return identify(docs, train(docs))


QUERIES = {"op2_language_id": op2_language_id}
ORACLE = {}
