"""Operator 10: order MinHash fingerprints (DataFrame and SQL functions only).

* Elements. A text is read as tokens: runs of at most TOKEN characters outside
  white space (so text without white space has tokens too). Each K consecutive
  tokens are a k-mer (a shorter text is one k-mer); equal k-mers are numbered by
  their occurrence, so an element is (k-mer, occurrence), and elements are distinct.
* Selection. Elements get a random 64-bit place on a ring. The i-th permutation
  starts the ring at the i-th of SLOTS evenly spaced points, which is again a random
  order of the elements; its L minimal elements are the first L from there on. Only
  the sorted places are needed, one sort for all permutations.
* Tuples. The L elements of a slot are put back into their order in the text and
  hashed as a tuple. Texts that share elements but in another order differ, which
  is what makes the signature follow edit distance; likeness is the share of equal
  slots.

Everything is arrays within a row, so a fingerprint needs no shuffle, and a text of
any length stays one row. Neighbours by id come from a narrow table (ids, hashes,
signatures), range-sorted; one shuffle then brings each text together with the
first quarter's worth of the next one.

Rows: a null text is empty; empty texts have one fixed fingerprint and likeness 1
to each other. Rows are ordered by (doc_id with null first, sha-256 of the text);
rows that repeat both are one document in this order and get equal results. The
last row's next is the first; a lone row is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import common as C

TOKEN, K, L, SLOTS_BITS = 8, 2, 2, 5
SLOTS = 1 << SLOTS_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _at(h: Column, position: Column) -> Column:
    """A hash with its place in the text; sorted by hash, then place."""
    return F.struct(h.alias("h"), position.alias("p"))


def _upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _kmers(tokens: Column, k: int) -> Column:
    """The k-mers of a text, sorted by hash and then position."""
    n = F.greatest(F.size(tokens) - (k - 1), F.least(F.size(tokens), F.lit(1)))
    return F.sort_array(F.transform(_upto(n), lambda i: _at(F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]), i)))


def _elements(kmers: Column) -> Column:
    """Elements (k-mer, occurrence), sorted by their place on the ring."""
    place = lambda x, nth: _at(F.xxhash64(x["h"], nth), x["p"])
    again = lambda x, j: F.get(kmers, j - 1)["h"] == x["h"]
    once = F.transform(F.filter(kmers, lambda x, j: (j == 0) | ~again(x, j)), lambda x: place(x, F.lit(0)))

    def repeated(at: Column) -> Column:
        """Occurrences 1, 2, ... from the (few) indices of k-mers equal to the one before."""
        starts = F.filter(_upto(F.size(at)), lambda r: (r == 0) | (F.get(at, r - 1) != F.get(at, r) - 1))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda r, i: F.transform(
            F.sequence(r, F.coalesce(F.get(s, i + 1), F.size(at)) - 1),
            lambda x: place(F.get(kmers, F.get(at, x)), x - r + 1)))))
    indices = F.filter(_upto(F.size(kmers)), lambda j: (j > 0) & again(F.get(kmers, j), j))
    return F.sort_array(F.concat(once, let(indices, repeated)))


def _slots(e: Column, ell: int) -> Column:
    """The hashed tuple of every slot."""
    n = F.size(e)
    bins = F.transform(e, lambda x: (F.shiftright(x["h"], 64 - SLOTS_BITS) + SLOTS // 2).cast("int"))
    every = F.sequence(F.lit(0), F.lit(SLOTS - 1))

    def tuple_at(j: Column) -> Column:
        chosen = F.transform(_upto(F.least(F.lit(ell), n)), lambda q: let(
            F.get(e, F.pmod(j + q, n)), lambda x: F.struct(x["p"], x["h"])))
        return F.xxhash64(F.transform(F.sort_array(chosen), lambda s: s["h"]))

    def from_first(first: Column) -> Column:
        # an empty bin takes what follows on the ring
        return F.transform(every, lambda i: tuple_at(F.coalesce(
            F.get(F.filter(F.slice(first, i + 1, F.lit(SLOTS)), lambda p: p > 0), F.lit(0)) - 1, F.lit(0)).cast("int")))
    return let(bins, lambda b: let(F.transform(every, lambda i: F.array_position(b, i)), from_first))


def signature(text: Column, k: int = K, ell: int = L) -> Column:
    """array<int> of SLOTS numbers, 32 bits each."""
    tokens = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]{1,%d}" % TOKEN), F.lit(0))
    sig = let(tokens, lambda t: let(_kmers(t, k), lambda s: let(_elements(s), lambda e: F.when(
        F.size(e) > 0, F.transform(_slots(e, ell), lambda v: F.shiftright(v, 32).cast("int"))).otherwise(
        F.array_repeat(F.lit(0), SLOTS)))))
    return sig


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)
    return F.size(same) / F.lit(float(SLOTS))


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds next_* and previous_* of ``rows`` (key, doc_id, sha, n_chars, sig) in their order, as a ring."""
    order = ["doc_id", "sha"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = C.scratch(rows.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "omh-order")
    row = F.struct("key", "n_chars", "sig")
    inside = Window.partitionBy("pid").orderBy(*order)
    # a row per range: what lies before and after it
    ends = sorted_.groupBy("pid").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), *order, row.alias("row")))["row"].alias("first"),
                                      F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), *order, row.alias("row")))["row"].alias("last"))
    ring = Window.orderBy("pid")
    whole = Window.partitionBy()
    around = ends.select("pid", F.coalesce(F.lead("first").over(ring), F.min_by("first", "pid").over(whole)).alias("after"),
                         F.coalesce(F.lag("last").over(ring), F.max_by("last", "pid").over(whole)).alias("before"))
    return (sorted_.withColumn("next", F.lead(row).over(inside)).withColumn("previous", F.lag(row).over(inside))
                   .join(F.broadcast(around), "pid")           # as many rows as shuffle partitions
                   .select(*rows.columns, F.coalesce("next", "after").alias("next"),
                           F.coalesce("previous", "before").alias("previous")))


def fingerprints(docs: DataFrame, k: int = K, ell: int = L) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = C.pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    texts = texts.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), "sha"))
    rows = C.scratch(texts.select("key", "doc_id", "sha", F.char_length("text").cast("long").alias("n_chars"),
                                  signature(F.col("text"), k, ell).alias("sig")), "omh-rows").dropDuplicates(["key"])
    ring = C.scratch(neighbours(rows).select(
        "key", "doc_id", "n_chars", "sig", F.col("next.sig").alias("next_sig"), F.col("previous.key").alias("previous"),
        F.floor(F.col("previous.n_chars") / 4).cast("int").alias("wanted")), "omh-ring")
    # both joins below read the same columns of this exchange, so the texts are shuffled once
    placed = texts.select("key", "text").repartition("key")
    heads = (placed.join(ring.select("key", "previous", "wanted"), "key")
                   .select(F.col("previous").alias("key"), F.col("text").substr(F.lit(1), F.col("wanted")).alias("head"))
                   .dropDuplicates(["key"]))
    quarter = F.floor(F.col("n_chars") / 4)
    edited = (placed.join(ring.select("key", "doc_id", "n_chars", "sig", "next_sig"), "key").join(heads, "key")
                    .withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - quarter).cast("int")), "head")))
    out = edited.select("doc_id", "n_chars", "sig", "next_sig", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        signature(F.col("edited"), k, ell).alias("edited_sig"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"),
                      as_text(F.col("edited_sig")).alias("edited_fingerprint"),
                      likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                      likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.documents(spark, sf_dir))


QUERIES = {"op10_order_minhash": op10_order_minhash}
ORACLE = {}
