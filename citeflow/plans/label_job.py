"""Paper labelling jobs (B4, B5, T3) and their parts as named queries.

Inputs derived from the tables (written once per scale directory under the
shared checkpoint folder):

* high pool: parts with ``p_size >= 41``
* latest pool, by day: PROMO parts, dated by their last order
* scholar pool, by day: parts of urgent orders, keyed by the customer (the
  "scholar"), events alternately named ``pub_id`` / ``event_pub_id``
* vocabulary documents and the subject index
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..fixtures import Fixtures
from ..functions.text import day_tag, format_keyword
from ..operators import label as L
from ..operators.embed import RandomProjectionEmbedder
from ..session import mark_ready, reusable_path, scratch_path
from ..sources import pools as P
from ..sources import vocab as VS

RUN_TS = _dt.datetime(2001, 8, 1, 0, 0, 0)
_WRITTEN: dict[tuple[str, str], str] = {}


def part_day(fx: Fixtures) -> DataFrame:
    """Last order day of each part."""
    li = fx.table("lineitem").select("l_orderkey", "l_partkey")
    o = fx.table("orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                  F.to_date("o_orderdate").alias("d"))
    return li.join(o, "l_orderkey").groupBy(F.col("l_partkey").alias("p_partkey")) \
             .agg(F.max("d").alias("day"))


def label_inputs(spark: SparkSession, sf: str) -> str:
    """Write the derived pool files, vocabulary and subject index; return their root."""
    root, ready = reusable_path(spark, f"label-inputs-{sf}", _WRITTEN)
    if ready:
        return root
    fx = Fixtures(spark, sf)
    part = fx.table("part")
    (part.where(F.col("p_size") >= 41)
     .select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("_id"),
                                F.col("p_name").alias("title"))).alias("value"))
     .write.mode("overwrite").text(f"{root}/high"))
    latest = (part.where(F.col("p_type") == "PROMO").join(part_day(fx), "p_partkey")
              .select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("pub_id"),
                                         F.col("p_name").alias("title"))).alias("value"), "day"))
    # an explicit count keeps one writer per shuffle partition (AQE would
    # otherwise coalesce this small shuffle into a single writing task)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    latest.repartition(n, "day").write.mode("overwrite").partitionBy("day").text(f"{root}/latest")
    li = fx.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    urgent = fx.table("orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("scholar"),
        F.to_date("o_orderdate").alias("day"))
    ev = li.join(urgent, "l_orderkey").select(
        "scholar", "day",
        F.when(F.col("l_linenumber") % 2 == 1,
               F.struct(F.col("l_partkey").cast("string").alias("pub_id"),
                        F.lit(None).cast("string").alias("event_pub_id")))
         .otherwise(F.struct(F.lit(None).cast("string").alias("pub_id"),
                             F.col("l_partkey").cast("string").alias("event_pub_id"))).alias("e"))
    lines = (ev.groupBy("scholar", "day").agg(F.collect_list("e").alias("evs"))
             .select(F.to_json(F.create_map("scholar", "evs")).alias("value"), "day"))
    lines.repartition(n, "day").write.mode("overwrite").partitionBy("day").text(f"{root}/scholar")
    VS.write_vocab(fx.vocab(), f"{root}/vocab")
    VS.write_subject_index(fx.subject(), f"{root}/subject_index")
    mark_ready(spark, root)
    return root


def _pools(spark, sf, start=None, end=None) -> DataFrame:
    return P.read_pools(spark, label_inputs(spark, sf), start, end)


def _papers(fx: Fixtures) -> DataFrame:
    return fx.paper_keywords().select(F.col("paper_id").cast("string").alias("paper_id"), "keywords")


def strong_match(spark: SparkSession, sf: str, start=None, end=None) -> DataFrame:
    """Pools -> papers (each once) -> keyword labels."""
    fx = Fixtures(spark, sf)
    ids = _pools(spark, sf, start, end)
    vocab = VS.read_vocab(spark, f"{label_inputs(spark, sf)}/vocab")
    return L.match_keywords(L.lookup(ids, _papers(fx), ["keywords"]), vocab)


def label_store_old(fx: Fixtures) -> DataFrame:
    """Existing label store: half of the parts, labelled long ago."""
    return fx.table("part").where(F.col("p_size") <= 25).select(
        F.col("p_partkey").cast("string").alias("pub_id"),
        F.array(F.lower("p_type")).alias("labels"),
        F.lit(_dt.datetime(2000, 1, 1)).cast("timestamp_ntz").alias("create_time"),
        F.lit(_dt.datetime(2000, 6, 1)).cast("timestamp_ntz").alias("modify_time"))


def run_ts():
    return F.lit(RUN_TS).cast("timestamp_ntz")


# ---- named queries -----------------------------------------------------------

def q_vocab_scan(spark, sf):
    return VS.read_vocab(spark, f"{label_inputs(spark, sf)}/vocab")


def q_format_keywords(spark, sf):
    k = Fixtures(spark, sf).paper_keywords()
    ex = k.select("paper_id", F.posexplode("keywords").alias("pos", "raw"))
    return ex.select("paper_id", F.col("pos").cast("bigint").alias("pos"), "raw",
                     format_keyword("raw").alias("word"))


def q_pool_latest(spark, sf):
    return P.read_latest(spark, f"{label_inputs(spark, sf)}/latest")


def q_pool_high(spark, sf):
    return P.read_high(spark, f"{label_inputs(spark, sf)}/high")


def q_pool_scholar(spark, sf):
    return P.read_scholar(spark, f"{label_inputs(spark, sf)}/scholar")


def q_pool_union(spark, sf):
    return _pools(spark, sf).select("pool", F.col("pool_rank").cast("bigint").alias("pool_rank"),
                                    "paper_id")


def _pool_dirs(spark, sf):
    root = label_inputs(spark, sf)
    return [f"{root}/latest", f"{root}/scholar", f"{root}/high", f"{root}/missing"]


def q_pool_discover(spark, sf):
    return P.discover(spark, _pool_dirs(spark, sf))


def q_pool_route(spark, sf):
    return P.route(spark, _pool_dirs(spark, sf)).select("pool", "paper_id")


def q_day_expand(spark, sf):
    """Days of the last week before the run day (the run day dropped)
    with the number of latest-pool records each day holds (partition-pruned read)."""
    start, end = C.AS_OF - _dt.timedelta(days=7), C.AS_OF
    days = spark.range(1).select(F.explode(P.day_range(start, end, drop_last=True)).alias("day"))
    recs = P.read_latest(spark, f"{label_inputs(spark, sf)}/latest", start, end)
    counts = recs.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select(
        day_tag("day").alias("tag"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def q_lookup_by_ids(spark, sf):
    fx = Fixtures(spark, sf)
    return L.lookup(_pools(spark, sf), _papers(fx), ["keywords"])


def q_label_strong_match(spark, sf):
    return strong_match(spark, sf)


def q_label_upsert(spark, sf):
    fx = Fixtures(spark, sf)
    return L.upsert(label_store_old(fx), strong_match(spark, sf), run_ts())


def q_labels_json(spark, sf):
    """K2: label list written as JSON lines and read back."""
    out = scratch_path(spark, "labels-json")
    strong_match(spark, sf).write.mode("overwrite").json(out)
    return spark.read.schema("pub_id string, labels array<string>").json(out)


def q_subject_index(spark, sf):
    return VS.read_subject_index(spark, f"{label_inputs(spark, sf)}/subject_index")


def knn_label_papers(fx: Fixtures) -> DataFrame:
    """Papers to label by vector: every vector that is not a subject."""
    subj = fx._label_representative("min").select("vec_id")
    e = fx.table("embeddings")
    return e.join(subj, "vec_id", "left_anti").select(F.col("vec_id").alias("pub_id"),
                                                       F.col("embedding").alias("vec"))


def q_label_knn(spark, sf):
    """Nearest two subjects per paper (L2), names from the subject index."""
    fx = Fixtures(spark, sf)
    idx = VS.read_subject_index(spark, f"{label_inputs(spark, sf)}/subject_index")
    subjects = fx.subject().select("subject_id", "embedding").join(idx, "subject_id")
    return L.nearest_subjects(knn_label_papers(fx), subjects, C.LABEL_TOPK)


def q_label_candidates(spark, sf):
    """Papers with a title are labelled; those without are left out."""
    have, _ = L.titled(Fixtures(spark, sf).doc())
    return have.select(F.col("doc_id").alias("pub_id"), "title")


def q_label_skipped(spark, sf):
    """How many papers are labelled and how many have no title; German documents are taken as untitled."""
    fx = Fixtures(spark, sf)
    lang = fx.table("documents").select("doc_id", "lang")
    d = fx.doc().join(lang, "doc_id").withColumn("title", F.when(F.col("lang") != "de", F.col("title")))
    have, none = L.titled(d)
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("c"), "n")
    both = n(have, "n_titled").unionByName(n(none, "n_untitled"))
    return both.agg(*[F.max(F.when(F.col("c") == c, F.col("n"))).alias(c) for c in ("n_titled", "n_untitled")])


def q_label_nearest_job(spark, sf):
    """The whole job by nearest subject: pools, lookup, encoding (model plug-in), two nearest words, upsert."""
    fx = Fixtures(spark, sf)
    titles = fx.table("part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    papers = L.lookup(_pools(spark, sf), titles, ["title"])
    vocab = VS.read_vocab(spark, f"{label_inputs(spark, sf)}/vocab")
    labels = L.label_by("nearest", papers, vocab, RandomProjectionEmbedder())
    done = L.upsert(label_store_old(fx), labels, run_ts())
    return done.select("pub_id", F.size("labels").cast("bigint").alias("n_labels"), "create_time", "modify_time")


QUERIES = {
    "vocab_scan": q_vocab_scan,
    "format_keywords": q_format_keywords,
    "pool_latest": q_pool_latest,
    "pool_high": q_pool_high,
    "pool_scholar": q_pool_scholar,
    "pool_union": q_pool_union,
    "pool_discover": q_pool_discover,
    "pool_route": q_pool_route,
    "day_expand": q_day_expand,
    "lookup_by_ids": q_lookup_by_ids,
    "label_strong_match": q_label_strong_match,
    "label_upsert": q_label_upsert,
    "labels_json": q_labels_json,
    "subject_index": q_subject_index,
    "label_knn": q_label_knn,
    "label_candidates": q_label_candidates,
    "label_skipped": q_label_skipped,
    "label_nearest_job": q_label_nearest_job,
}

_FMT = "lower(regexp_replace(replace({x}, '-', ' '), '^\\s+|\\s+$', '', 'g'))"

ORACLE = {
    "vocab_scan": "SELECT word FROM vocab",
    "pool_route": "SELECT pool, paper_id FROM label_pool_ids",
    "label_candidates": "SELECT doc_id AS pub_id, title FROM doc WHERE length(trim(title)) > 0",
    "label_skipped": """
        SELECT count(*) FILTER (d.lang <> 'de' AND length(trim(x.title)) > 0) AS n_titled,
               count(*) FILTER (NOT (d.lang <> 'de' AND length(trim(x.title)) > 0)) AS n_untitled
        FROM doc x JOIN documents d ON d.doc_id = x.doc_id""",
    "label_nearest_job": """
        SELECT COALESCE(o.pub_id, n.pub_id) AS pub_id,
               CASE WHEN n.pub_id IS NOT NULL THEN CAST(2 AS BIGINT) ELSE CAST(len(o.labels) AS BIGINT) END AS n_labels,
               COALESCE(o.create_time, TIMESTAMP '2001-08-01 00:00:00') AS create_time,
               CASE WHEN n.pub_id IS NOT NULL THEN TIMESTAMP '2001-08-01 00:00:00' ELSE o.modify_time END AS modify_time
        FROM label_old o FULL OUTER JOIN (
          SELECT DISTINCT paper_id AS pub_id FROM label_pool_ids
          WHERE paper_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE length(trim(p_name)) > 0)) n
          ON n.pub_id = o.pub_id""",
    "format_keywords": f"""
        SELECT paper_id, pos, raw, {_FMT.format(x='raw')} AS word FROM (
          SELECT paper_id, unnest(range(0, len(keywords))) AS pos, unnest(keywords) AS raw
          FROM paper_keywords)""",
    "pool_latest": """
        SELECT CAST(p.p_partkey AS VARCHAR) AS paper_id, d.day FROM part p JOIN part_day d ON d.pid = p.p_partkey
        WHERE p.p_type = 'PROMO'""",
    "pool_high": "SELECT CAST(p_partkey AS VARCHAR) AS paper_id FROM part WHERE p_size >= 41",
    "pool_scholar": """
        SELECT CAST(o.o_custkey AS VARCHAR) AS scholar_id, CAST(l.l_partkey AS VARCHAR) AS paper_id,
               CAST(o.o_orderdate AS DATE) AS day
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority = '1-URGENT'""",
    "pool_union": "SELECT pool, pool_rank, paper_id FROM label_pool_ids",
    "day_expand": """
        SELECT strftime(g.day, '%Y_%m_%d') AS tag, COALESCE(c.n, 0) AS n
        FROM (SELECT CAST(unnest(generate_series(DATE '2001-07-25', DATE '2001-07-31', INTERVAL 1 DAY)) AS DATE) AS day) g
        LEFT JOIN (SELECT d.day, COUNT(*) AS n FROM part p JOIN part_day d ON d.pid = p.p_partkey
                   WHERE p.p_type = 'PROMO' GROUP BY d.day) c ON c.day = g.day""",
    "lookup_by_ids": "SELECT paper_id, keywords FROM label_papers",
    "label_strong_match": "SELECT pub_id, labels FROM strong_labels",
    "label_upsert": """
        SELECT COALESCE(o.pub_id, n.pub_id) AS pub_id,
               CASE WHEN n.pub_id IS NOT NULL THEN n.labels ELSE o.labels END AS labels,
               COALESCE(o.create_time, TIMESTAMP '2001-08-01 00:00:00') AS create_time,
               CASE WHEN n.pub_id IS NOT NULL THEN TIMESTAMP '2001-08-01 00:00:00' ELSE o.modify_time END AS modify_time
        FROM label_old o FULL OUTER JOIN strong_labels n ON o.pub_id = n.pub_id""",
    "labels_json": "SELECT pub_id, labels FROM strong_labels",
    "subject_index": "SELECT subject_id, word FROM subject",
    "label_knn": f"""
        SELECT pub_id, list(word ORDER BY rk) AS labels FROM (
          SELECT p.vec_id AS pub_id, s.word,
                 row_number() OVER (PARTITION BY p.vec_id ORDER BY {{l2}}, s.subject_id) AS rk
          FROM embeddings p JOIN subject s ON p.vec_id NOT IN (SELECT rep_id FROM subject))
        WHERE rk <= 2 GROUP BY pub_id""",
}

from .oracle_views import VIEWS as _V, l2sql as _l2  # noqa: E402

ORACLE["label_knn"] = ORACLE["label_knn"].replace("{l2}", _l2("p.embedding", "s.embedding"))

_V.update({
    "part_day": """
        SELECT l.l_partkey AS pid, MAX(CAST(o.o_orderdate AS DATE)) AS day
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey""",
    "label_pool_ids": """
        SELECT 'high' AS pool, CAST(0 AS BIGINT) AS pool_rank, CAST(p_partkey AS VARCHAR) AS paper_id FROM part WHERE p_size >= 41
        UNION ALL
        SELECT 'latest', 1, CAST(p.p_partkey AS VARCHAR) FROM part p JOIN part_day d ON d.pid = p.p_partkey
        WHERE p.p_type = 'PROMO'
        UNION ALL
        SELECT 'scholar', 2, CAST(l.l_partkey AS VARCHAR)
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority = '1-URGENT'""",
    "paper_keywords": """
        SELECT p_partkey AS paper_id,
               [upper(replace(p_name, ' ', '-')), ' ' || p_type || ' ', p_brand] AS keywords FROM part""",
    "vocab": """
        SELECT DISTINCT lower(p_name) AS word FROM part
        UNION SELECT 'economy'""",
    "label_papers": """
        SELECT CAST(paper_id AS VARCHAR) AS paper_id, keywords FROM paper_keywords
        WHERE CAST(paper_id AS VARCHAR) IN (SELECT paper_id FROM label_pool_ids)""",
    "strong_labels": f"""
        SELECT k.paper_id AS pub_id, COALESCE(h.labels, CAST([] AS VARCHAR[])) AS labels
        FROM label_papers k LEFT JOIN (
          SELECT paper_id, list(word ORDER BY pos) AS labels FROM (
            SELECT paper_id, pos, {_FMT.format(x='raw')} AS word FROM (
              SELECT paper_id, unnest(range(0, len(keywords))) AS pos, unnest(keywords) AS raw
              FROM label_papers))
          WHERE word IN (SELECT word FROM vocab) GROUP BY paper_id) h ON h.paper_id = k.paper_id""",
    "label_old": """
        SELECT CAST(p_partkey AS VARCHAR) AS pub_id, [lower(p_type)] AS labels,
               TIMESTAMP '2000-01-01 00:00:00' AS create_time, TIMESTAMP '2000-06-01 00:00:00' AS modify_time
        FROM part WHERE p_size <= 25""",
    "subject": """
        SELECT CAST(e.label AS BIGINT) AS subject_id, 'subject_' || CAST(e.label AS VARCHAR) AS word,
               e.embedding, e.vec_id AS rep_id
        FROM embeddings e JOIN (SELECT label, MIN(vec_id) AS m FROM embeddings GROUP BY label) r
          ON r.label = e.label AND r.m = e.vec_id""",
})
