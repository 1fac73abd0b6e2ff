"""Operator 4: mixing sources to target weights by weighted fair queueing.

* Targets. Sources by code point, null last, weigh 3, 1, 2, repeating. They share
  a budget (a multiple of all words) by weight; a source's target stops at
  ``max_repeats`` times its words and the excess is shared again by weight, until
  no target is above (the water level of a sorted list, one row per source).
* Queue. Every document enters its source's queue ``max_repeats`` times, pass by
  pass, in an order shuffled by a hash of its id. Its virtual finish time is the
  source's cumulative words divided by the source's target, so at time 1 every
  source has been served its target. Documents are taken whole: the copy on which a
  source reaches its target is in the mix if the source then ends nearer to its
  target than without it (just when half of the copy lies before the target), so a
  source misses its target by at most half of that document.
* Schedule. The copies are range-sorted globally by finish time. Up to the total
  budget, which is the sum of the targets, that order holds the copies that end by
  time 1, give or take the one of each source that time 1 falls into, so the
  truncation is a comparison per copy and needs no running sum over all rows.

Cumulative words are prefix sums in two levels (hash ranges of a source, then rows
of a range), so a source with a third of all rows is spread over BUCKETS windows.
Everything is DataFrame code.

Rows: null text has size 0; such documents have taken 0. Null ids and rows that
repeat an id are documents of their own; ties of the shuffle are broken by id and
size (equal rows then differ in nothing). No words at all give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = "mix"
BUCKETS = 4096                  # the first three hex digits of the shuffle hash


def n_words(text: Column) -> Column:
    """Runs of characters outside white space: non-space characters that follow a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds weight and target to (source, source_size), one row per source.

    The windows run over one row per source, a short list; its sums are exact in
    long arithmetic, so they come out alike in any order.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int")).cast("long")
    cap = F.col("source_size") * max_repeats
    # sources fill up in the order cap / weight; the level is set by the first that does not
    level = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = (sizes.withColumn("weight", w)
              .withColumn("level", (total * F.lit(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
                          / F.sum("weight").over(after))
              .withColumn("open", F.col("level") * F.col("weight") <= cap))
    water = F.min(F.when(F.col("open"), F.struct((cap / F.col("weight")).alias("r"), "level"))).over(Window.partitionBy())
    return s.withColumn("water", water["level"]).select(
        *sizes.columns, "weight",
        F.when(F.col("source_size") == 0, F.lit(0.0))
         .when(F.col("water").isNull(), cap.cast("double"))
         .otherwise(F.least(cap.cast("double"), F.col("water") * F.col("weight"))).alias("target"))


def _keyed(docs: DataFrame, seed: str, keep: list[str]) -> DataFrame:
    """``doc`` (the columns to keep) and what the queue needs of a row."""
    at = lambda c, t: F.col(f"`{c}`").cast(t) if c in docs.columns else F.lit(None).cast(t)
    turn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(at("doc_id", "string"), F.lit(""))).cast("binary"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
                    at("doc_id", "long").alias("doc_id"), at("source", "string").alias("source"),
                    n_words(at("text", "string")).alias("size"), turn.alias("turn"))
    # a key that is never null, so that windows and joins share one partitioning
    return (d.withColumn("queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
             .withColumn("bucket", F.conv(F.substring("turn", 1, 3), 16, 10).cast("int")))


def queued(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS,
           seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """One row per document with its place in its source's queue: doc (struct of its columns, or those in
    ``keep``), doc_id, source, size, turn, start (words ahead of it in one pass), source_size, target."""
    C.ensure_checkpoint_dir(docs.sparkSession)
    rows = _keyed(docs, seed, docs.columns if keep is None else keep)
    part = rows.groupBy("queue", "source", "bucket").agg(F.sum("size").alias("words"))
    part = C.scratch(part, "mix-parts")
    goal = targets(part.groupBy("queue", "source").agg(F.sum("words").alias("source_size")),
                   weights, budget, max_repeats)
    w = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("queue", "bucket", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("before")) \
               .join(goal.select("queue", "source_size", "target"), "queue")
    inside = (Window.partitionBy("queue", "bucket").orderBy("turn", "doc_id", "size")
                    .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                .join(part, ["queue", "bucket"])
                .select("doc", "doc_id", "source", "size", "turn", (F.col("before") + F.col("ahead")).alias("start"),
                        "source_size", "target"))


def _words(n: int):
    """Words taken of the copy of pass ``n``: all, or none."""
    begin = F.col("start") + F.lit(n) * F.col("source_size")
    return F.when(2 * begin + F.col("size") <= 2 * F.floor("target"), F.col("size")).otherwise(F.lit(0)).cast("long")


def schedule(q: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix: one row per copy taken, range-sorted by finish time; adds pass, words, finish."""
    passes = F.array(*[F.struct(F.lit(n).alias("pass"), _words(n).alias("words")) for n in range(max_repeats)])
    c = q.withColumn("copy", F.explode(passes)).select("*", "copy.pass", "copy.words").drop("copy").where("words > 0")
    served = F.col("start") + F.col("pass") * F.col("source_size") + F.col("words")
    return c.withColumn("finish", served / F.floor("target")).orderBy("finish", "turn", "pass", "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix in schedule order, with the columns of ``docs``.

    A document taken twice is two rows; documents without words are in no mix.
    """
    c = schedule(queued(docs))
    return c.select(*[F.col(f"doc.`{x}`").alias(x) for x in docs.columns])


def taken(docs: DataFrame) -> DataFrame:
    """One row per document, from the schedule: doc_id, size, source_size, target, taken, finish (of its last copy)."""
    row, = C.unused(docs.columns, "row")
    q = queued(C.numbered(docs, row), keep=[row]).withColumn("row", F.col(f"doc.`{row}`")).drop("doc")
    q = C.scratch(q, "mix-queue")
    mix = C.scratch(schedule(q).select("row", "words", "finish"), "mix-schedule")
    copies = mix.groupBy("row").agg(F.sum("words").alias("taken"), F.max("finish").alias("finish"))
    return q.join(copies, "row", "left").select("doc_id", "size", "source_size", "target",
                                                F.coalesce("taken", F.lit(0)).alias("taken"), "finish")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(C.documents(spark, sf_dir)).drop("finish")


QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
         coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2 * source_size AS cap
  FROM s),
l AS (
  SELECT *, cap / weight AS r,
         ((SELECT sum(size) FROM d) * CAST(1.5 AS DOUBLE)
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w),
water AS (SELECT lvl FROM l WHERE lvl * weight <= cap ORDER BY r, lvl LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(cap AS DOUBLE), coalesce((SELECT lvl FROM water) * weight, CAST(cap AS DOUBLE))) END AS target
  FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN 2 * begin + size <= 2 * floor(target) THEN size ELSE 0 END
            + CASE WHEN 2 * (begin + source_size) + size <= 2 * floor(target) THEN size ELSE 0 END AS BIGINT) AS taken
FROM q"""}
