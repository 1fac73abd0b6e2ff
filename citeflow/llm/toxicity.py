"""Operator 6: toxicity by a fuzzy lexicon and the context of its matches.

* Lexicon. Words that toxic training texts use far more than others do (smoothed
  log-odds of document frequencies, counted once per different text), from at most
  TRAIN labelled rows (a documented bound, chosen by a hash of the id).
  Stems count as terms too (the first 4 to 6 letters of several longer words, written
  with a ``*``), so that inflected and compound forms are found that no training text
  has; a stem takes more evidence and no misspelling.
* Automaton. The lexicon is a trie; a state is the set of (trie node, edits so far)
  that Levenshtein automata of all its terms can be in after a prefix, so reading a
  word once finds every term within its edit distance (1 from 5 letters, 2 from
  10). States are made when first reached and kept in a bounded table. A word that
  other training texts use as a word of their own (its log-odds stay below those of a
  term) never counts as a misspelling; its terms keep all their other misspellings.
* Context. A match counts with its term's weight, less if misspelled, and less if
  it is quoted: inside quotation marks (at most ``quotation`` words after the opening
  one, as an apostrophe may look like it), or within ``window`` words of a word of
  reporting. The text's score is a logistic function of the sum, its sharpest match
  and its density, fitted on the sample.

Workers keep the words they have looked at in a bounded table. Rows: a null text is
empty; texts without a match get the score of no evidence. A null id counts as the
empty text for the fold. Rows that repeat an id are scored one by one. Without
toxic training rows the lexicon is empty and every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLD, HELD_OUT = 3, 1
TRAIN = 20_000
MIN_TEXTS = 3               # toxic training texts that use a term
MIN_LOG_ODDS = 3.0
STEMS, STEM_TEXTS, STEM_LOG_ODDS = (4, 5, 6), 5, 4.0
THRESHOLD = 0.7
WINDOW, QUOTATION = 6, 40
QUOTED, MISSPELLED = 0.25, 0.7
KNOWN_WORDS = 400_000       # words a worker remembers
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_OPEN, _CLOSE = "\"“„«‹'‘", "\"”“»›'’"
# words of reporting, in the languages of the corpus
REPORTING = ("said", "says", "wrote", "called", "quote", "quoted", "quoting", "reported", "word", "term", "slur", "insult",
             "sagte", "schrieb", "nannte", "zitat", "zitierte", "wort", "begriff",
             "dit", "écrit", "appelé", "citation", "cité", "mot", "terme", "insulte",
             "dijo", "escribió", "llamó", "cita", "citó", "palabra", "término", "insulto")


def bare(word: str) -> str:
    return _EDGES.sub("", word)


class FuzzyLexicon:
    """Levenshtein automata of all terms, intersected with the trie of the terms."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset(), max_moves: int = 1 << 18):
        self.terms = list(terms)
        self.weights = [terms[t] for t in self.terms]
        self.ordinary = ordinary                # words that are no misspelling of any term
        self.limit = [0 if t[-1] == "*" else self.edits(t) for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stems: dict[int, int] = {}         # by node: the stem that ends there
        self.most: list[int] = [0]              # edits that some term below a node allows
        for i, t in enumerate(self.terms):
            node = 0
            for ch in t.rstrip("*"):
                self.most[node] = max(self.most[node], self.limit[i])
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][ch]
            if t[-1] == "*":
                self.stems[node] = i
            else:
                self.ends[node] = i
            self.most[node] = max(self.most[node], self.limit[i])
        self.pieces: dict[int, dict[tuple[int, int], set[str]]] = {}
        for t, limit in zip(self.terms, self.limit):
            if limit:
                self._add_pieces(t, limit)
        self.places = {n: [(a, b, s) for (a, b), s in at.items()] for n, at in self.pieces.items()}
        self.max_moves = max_moves
        self._reset()

    def _add_pieces(self, t: str, limit: int) -> None:
        """Of a term in ``limit + 1`` pieces, an edited form keeps one: as its start, its end, or between one edit each."""
        n, q = len(t), len(t) // (limit + 1)
        for size in range(n - limit, n + limit + 1):
            at = self.pieces.setdefault(size, {})
            kept = [(0, t[:q]), (size - (n - limit * q), t[limit * q:])]
            if limit == 2:
                kept += [(q + shift, t[q:2 * q]) for shift in (-1, 0, 1)]
            for a, piece in kept:
                if a >= 0:
                    at.setdefault((a, a + len(piece)), set()).add(piece)

    def _maybe(self, word: str) -> bool:
        """False if no term can be within its distance of ``word``; spares the automata most words."""
        for a, b, pieces in self.places.get(len(word), ()):
            if word[a:b] in pieces:
                return True
        return False

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 10 else 2

    def _reset(self) -> None:
        self.states: list[frozenset] = [frozenset()]        # by number; 0 is the dead state
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.moves: list[dict[str, int]] = [{}]             # by state: the next one by letter, "" for all that no term has there
        self.found: dict[int, list[tuple[int, float, int]]] = {}
        self.made = 0
        self.start = self._number(self._closed({0: 0}))

    def _number(self, state: frozenset) -> int:
        got = self.numbers.setdefault(state, len(self.states))
        if got == len(self.states):
            self.states.append(state)
            self.moves.append({})
        return got

    def _closed(self, best: dict[int, int]) -> frozenset:
        """Adds what skipping letters of a term reaches."""
        stack = list(best.items())
        while stack:
            node, e = stack.pop()
            if best.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and best.get(child, 99) > e + 1:
                    best[child] = e + 1
                    stack.append((child, e + 1))
        return frozenset(best.items())

    def _move(self, number: int, ch: str) -> int:
        state, moves = self.states[number], self.moves[number]
        if not any(ch in self.children[node] for node, _ in state):
            if "" in moves:
                moves[ch] = moves[""]
                return moves[""]
        best: dict[int, int] = {}
        known = False
        for node, e in state:
            if e + 1 <= self.most[node] and best.get(node, 99) > e + 1:             # a letter too many
                best[node] = e + 1
            for c, child in self.children[node].items():
                known |= c == ch
                now = e if c == ch else e + 1                                       # right or wrong letter
                if now <= self.most[child] and best.get(child, 99) > now:
                    best[child] = now
        moves[ch] = got = self._number(self._closed(best))
        if not known:
            moves[""] = got
        self.made += 1
        return got

    def _run(self, word: str) -> list[tuple[int, float, int]]:
        """(edits, -weight, term) of every term whose automaton accepts ``word``."""
        if not self._maybe(word):
            return []
        if self.made > self.max_moves:
            self._reset()
        at, moves = self.start, self.moves
        for ch in word:
            to = moves[at].get(ch)
            at = self._move(at, ch) if to is None else to
            if not at:
                return []
        got = self.found.get(at)
        if got is None:
            got = self.found[at] = [(e, -self.weights[i], i) for n, e in self.states[at]
                                    if (i := self.ends[n]) >= 0 and e <= self.limit[i]]
        return got

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term within its distance; the heavier of equals."""
        node, hits = 0, []
        for at, ch in enumerate(word, 1):
            node = self.children[node].get(ch, -1)
            if node < 0:
                break
            if node in self.stems and at < len(word):
                hits.append((0, -self.weights[self.stems[node]], self.stems[node]))
        if node >= 0 and (i := self.ends[node]) >= 0:               # the word as written
            hits.append((0, -self.weights[i], i))
        if not hits and word not in self.ordinary:                  # misspelled, if at all
            hits = self._run(word)
        return (min(hits)[2], min(hits)[0]) if hits else None

    def misspelled(self, word: str) -> list[int]:
        """All terms that ``word`` would be a misspelling of; none if it is a term itself."""
        hits = self._run(word)
        return [] if any(e == 0 for e, _, _ in hits) else [i for _, _, i in hits]


class Model:
    """The lexicon and the logistic function of what it finds."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str], window: int = WINDOW, quotation: int = QUOTATION):
        self.terms, self.ordinary, self.window, self.quotation = terms, ordinary, window, quotation
        self.coef: np.ndarray | None = None

    def opened(self) -> Model:
        self.lexicon = FuzzyLexicon(self.terms, self.ordinary)
        self.known: dict[str, tuple[int, int] | None] = {}
        self.hits: set[str] = set()
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lexicon", "known", "hits")}

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: sum of matches, sharpest match, sum per 100 words."""
        out = np.zeros((len(texts), 3))
        words = [t.lower().split() for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.hits.clear()
        for w in set().union(*words) - self.known.keys() if words else ():
            self.known[w] = got = self.lexicon.find(bare(w))
            if got:
                self.hits.add(w)
        for i, ws in enumerate(words):
            if not self.hits.isdisjoint(ws):
                found = self._matches(ws)
                out[i] = sum(found), max(found), 100 * sum(found) / len(ws)
        return out

    def _matches(self, ws: list[str]) -> list[float]:
        quoted, inside = [], False
        for w in ws:                                # inside quotation marks, up to their end or the longest quotation
            opens, closes = w[0] in _OPEN, w[-1] in _CLOSE or bare(w) and w.rstrip(".,;:!?")[-1:] in _CLOSE
            inside = (inside or opens) and (not quoted or quoted[-1] < self.quotation)
            quoted.append((quoted[-1] if quoted and inside else 0) + 1 if inside else 0)
            if closes and (len(w) > 1 or not opens or quoted[-1] > 1):
                inside = False
        found = []
        for at, w in enumerate(ws):
            if w in self.hits:
                term, edits = self.known[w]
                near = ws[max(0, at - self.window):at] + ws[at + 1:at + 1 + self.window]
                reported = any(bare(x) in _REPORTING for x in near)
                found.append(self.lexicon.weights[term] * MISSPELLED ** edits
                             * (QUOTED if quoted[at] or reported else 1.0))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(_design(x) @ self.coef, -700, 700)))


_REPORTING = frozenset(REPORTING)


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression; the weights of evidence stay positive."""
    d = _design(x)
    b = np.zeros(d.shape[1])
    free = np.ones(b.size, bool)
    penalty = np.diag([0.0, *[ridge] * (b.size - 1)]) * 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
        g = d.T @ (y - p) - penalty @ b
        h = (d * (p * (1 - p))[:, None]).T @ d + penalty + 1e-6 * np.eye(b.size)
        step = np.zeros(b.size)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        b += step
        free[1:] &= ~(b[1:] < 0)
        b[1:] = np.maximum(b[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _forms(text: str) -> set[str]:
    """The different words of a text and their stems."""
    words = {b for w in set(text.lower().split()) if len(b := bare(w)) >= 3}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n and w[:n].isalpha()}


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, toxic, other): in how many texts of a slice, by label, a word or stem occurs."""
    for batch in batches:
        for part in C.slices(batch):
            found = Counter(), Counter()
            for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found[y].update(_forms(t))
            words = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in found[::-1]]],
                names=["word", "toxic", "other"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN) -> Model:
    spark = docs.sparkSession
    C.prepared(spark)
    sample = C.labelled_sample(docs, labels, "toxic", FOLD, HELD_OUT, rows, "toxic-sample")
    different = sample.distinct()
    n = Counter({r.label: r["count"] for r in different.groupBy("label").count().collect()})
    odds = F.log((F.col("toxic") + 0.1) / (n[1] + 1.0)) - F.log((F.col("other") + 0.1) / (n[0] + 1.0))
    stem = F.col("word").endswith("*")
    lexicon = (different.mapInArrow(_words, "word string, toxic long, other long").groupBy("word")
                        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
                        .where(F.col("toxic") >= F.when(stem, F.lit(STEM_TEXTS)).otherwise(F.lit(max(2, min(MIN_TEXTS, n[1] // 10)))))
                        .withColumn("odds", odds)
                        .where(F.col("odds") >= F.when(stem, F.lit(STEM_LOG_ODDS)).otherwise(F.lit(MIN_LOG_ODDS)))
                        .orderBy(F.desc(F.col("toxic") * F.col("odds")), "word").collect())    # words of at most ``rows`` texts
    # a stem must stand for several words: more texts have it than have its most frequent word
    most = Counter()
    for r in lexicon:
        for k in STEMS:
            most[r.word[:k] + "*"] = max(most[r.word[:k] + "*"], 0 if r.word[-1] == "*" else r.toxic)
    # ... and no longer stem has nearly all of them
    longer = Counter()
    for r in lexicon:
        if r.word[-1] == "*":
            for k in range(min(STEMS), len(r.word) - 1):
                longer[r.word[:k] + "*"] = max(longer[r.word[:k] + "*"], r.toxic)
    terms = {r.word: float(r.odds) for r in lexicon
             if r.word[-1] != "*" or r.toxic >= 1.5 * most[r.word] and longer[r.word] < 0.9 * r.toxic}
    context = spark.sparkContext
    near = (different.mapInArrow(_confused(context.broadcast(terms)), "word string, toxic long, other long").groupBy("word")
                     .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    # words of at most ``rows`` texts that lie within the distance of a term
    model = Model(terms, frozenset(r.word for r in near.where("other > 0").where(odds < MIN_LOG_ODDS).select("word").collect()))
    if terms:
        x = sample.mapInArrow(_evidence(context.broadcast(model)), "label int, total double, most double, dense double")
        x = x.toPandas().sort_values(["label", "total", "most", "dense"])   # at most ``rows`` rows of numbers
        model.coef = _logistic(x[["total", "most", "dense"]].to_numpy(), x.label.to_numpy())
    return model


def _confused(shared):
    """Rows (word, toxic, other): in how many texts of a slice, by label, a word occurs that a term could be misspelled as."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(shared.value)
        for batch in batches:
            for part in C.slices(batch):
                texts = [{bare(w) for w in t.lower().split()} for t in part.column(1).to_pylist()]
                near = {w for w in set().union(*texts) if lexicon.misspelled(w)}
                found = Counter(), Counter()
                for y, words in zip(part.column(0).to_pylist(), texts):
                    found[y].update(words & near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sorted(near), pa.string()), *[pa.array([c[w] for w in sorted(near)], pa.int64()) for c in found[::-1]]],
                    names=["word", "toxic", "other"])
    return run


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for batch in batches:
            for part in C.slices(batch):
                x = model.evidence(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in x.T]],
                                                 names=["label", "total", "most", "dense"])
    return run


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for batch in batches:
            for part in C.slices(batch):
                s = model.score(model.evidence(pc.fill_null(part.column(2), "").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    C.prepared(spark)
    d = C.pick(docs, doc_id="long", text="string").select(
        "doc_id", (C.crc_mod(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(_score(spark.sparkContext.broadcast(model), threshold),
                        "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE = {}
