"""Inputs of the jobs, derived from the driver's tables.

The original application reads papers, authorship, follows and activity from
services; here each input is a DataFrame that Spark derives from the given
parquet tables, so every job's work grows with those tables. Definitions
follow FIXTURES.md section 2, with the vector roles taken from the data
(label groups, labelled documents, order dates) instead of id ranges.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import config as C


class Fixtures:
    """Lazy DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str,
                 as_of: _dt.date = C.AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- papers and authors -------------------------------------------------
    def _of(self, name: str, key: str, ids: DataFrame | None) -> DataFrame:
        """A table, keyed by ``paper_id``; with ``ids`` only the rows of those papers."""
        t = self.table(name).withColumn("paper_id", F.col(key))
        return t if ids is None else t.join(ids.select("paper_id"), "paper_id", "left_semi")

    def paper(self, ids: DataFrame | None = None) -> DataFrame:
        """paper(paper_id, ts date, n_citation bigint), of all papers or of ``ids``.

        The line aggregate runs before the join (partial aggregation on the
        map side), so only one row per order reaches the join shuffle.
        """
        qty = (self._of("lineitem", "l_orderkey", ids).groupBy("paper_id")
               .agg(F.sum("l_quantity").alias("q")))
        orders = self._of("orders", "o_orderkey", ids).select("paper_id", F.to_date("o_orderdate").alias("ts"))
        return orders.join(qty, "paper_id").select(
            "paper_id", "ts", F.col("q").cast("bigint").alias("n_citation"))

    def authorship(self) -> DataFrame:
        """authorship(paper_id, author_id), one row per pair."""
        return (self.table("lineitem")
                .select(F.col("l_orderkey").alias("paper_id"),
                        F.col("l_suppkey").alias("author_id"))
                .distinct())

    def author(self) -> DataFrame:
        """author(author_id, name_en, name_zh): names present or absent by the data.

        An English name for suppliers in good standing (``s_acctbal >= 0``), a
        Chinese name for suppliers in the ASIA region; some have neither.
        """
        s = self.table("supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        r = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        j = s.join(n, "s_nationkey", "left").join(r, "n_regionkey", "left")
        return j.select(
            F.col("s_suppkey").alias("author_id"),
            F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("name_en"),
            F.when(F.col("r_name") == "ASIA", F.concat(F.lit("ZH-"), F.col("s_name"))).alias("name_zh"))

    def follow(self) -> DataFrame:
        """follow(user_id, author_id): sign-up events name a followed scholar."""
        ev = (self.table("events")
              .where(F.col("event_type") == "signup")
              .select("user_id",
                      F.get_json_object("props", "$.k").cast("bigint").alias("author_id"))
              .where(F.col("author_id").isNotNull())
              .distinct())
        return ev.join(self.author().select("author_id"), "author_id", "left_semi") \
                 .select("user_id", "author_id")

    def active(self, start: _dt.date = C.ACTIVE_START,
               end: _dt.date = C.ACTIVE_END) -> DataFrame:
        from .sources.activity import active_users
        return active_users(self.table("events"), start, end)

    # ---- pools -----------------------------------------------------------------
    def pool_high(self, min_citations: int = C.HIGH_MIN_CITATIONS, paper: DataFrame | None = None) -> DataFrame:
        return (self.paper() if paper is None else paper).where(F.col("n_citation") >= min_citations).select("paper_id")

    def pool_latest(self, days: int = C.LATEST_SPAN_DAYS, paper: DataFrame | None = None) -> DataFrame:
        return (self.paper() if paper is None else paper).where(
            F.col("ts") > F.date_sub(F.lit(self.as_of), days)).select("paper_id")

    def pool_newest(self, days: int = C.NEWEST_SPAN_DAYS, paper: DataFrame | None = None) -> DataFrame:
        return self.pool_latest(days, paper)

    # ---- per-paper dimensions ---------------------------------------------
    def paper_pv(self, ids: DataFrame | None = None) -> DataFrame:
        """paper_pv(paper_id, pv): line count of urgent orders."""
        urgent = self._of("orders", "o_orderkey", ids).where(F.col("o_orderpriority") == "1-URGENT").select("paper_id")
        lines = self._of("lineitem", "l_orderkey", ids).select("paper_id")
        return lines.join(urgent, "paper_id", "left_semi") \
                    .groupBy("paper_id").agg(F.count(F.lit(1)).alias("pv"))

    def paper_zone(self, ids: DataFrame | None = None) -> DataFrame:
        """paper_zone(paper_id, zone): sorted distinct return flags of filled orders."""
        filled = self._of("orders", "o_orderkey", ids).where(F.col("o_orderstatus") == "F").select("paper_id")
        lines = self._of("lineitem", "l_orderkey", ids).select("paper_id", "l_returnflag")
        return (lines.join(filled, "paper_id", "left_semi")
                .groupBy("paper_id")
                .agg(F.array_sort(F.collect_set("l_returnflag")).alias("zone")))

    def paper_keywords(self) -> DataFrame:
        """paper_keywords(paper_id, keywords array<string>) from parts."""
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("paper_id"),
            F.array(F.upper(F.regexp_replace("p_name", " ", "-")),
                    F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")),
                    F.col("p_brand")).alias("keywords"))

    def vocab(self) -> DataFrame:
        """vocab(word): subject words known to the labeller, the names of all parts."""
        names = self.table("part").select(F.lower("p_name").alias("word"))
        extra = self.spark.createDataFrame([("economy",)], "word string")
        return names.unionByName(extra).distinct()

    # ---- vectors ----------------------------------------------------------------
    def vec(self, since: _dt.date | None = None) -> DataFrame:
        """vec(pid, embedding, ts, label): vectors stamped with their order date.

        ``since`` keeps vectors stamped on or after that day; the predicate is
        on the raw timestamp column, so it reaches the parquet scan.
        """
        e = self.table("embeddings")
        o = self.table("orders")
        if since is not None:
            o = o.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp"))
        o = o.select(
            F.col("o_orderkey").alias("pid"),
            F.unix_timestamp("o_orderdate").alias("ts"))
        return e.select(F.col("vec_id").alias("pid"), "embedding", "label").join(o, "pid")

    def vec_id_map(self) -> DataFrame:
        """vec_id_map(pid, paper_id): only labelled documents have a paper id."""
        return self.table("labels").select(
            F.col("doc_id").alias("pid"),
            F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"))

    def _label_representative(self, pick: str) -> DataFrame:
        e = self.table("embeddings")
        agg = F.min if pick == "min" else F.max
        rep = e.groupBy("label").agg(agg("vec_id").alias("vec_id"))
        return e.join(rep, ["label", "vec_id"], "left_semi")

    def topics(self) -> DataFrame:
        """query_vec(q, embedding): one topic per label, its newest vector."""
        return self._label_representative("max").select(
            F.col("label").cast("bigint").alias("q"), "embedding")

    def subject(self) -> DataFrame:
        """subject(subject_id, word, embedding): one subject per label, its first vector."""
        return self._label_representative("min").select(
            F.col("label").cast("bigint").alias("subject_id"),
            F.concat(F.lit("subject_"), F.col("label").cast("string")).alias("word"),
            "embedding")

    def centroid(self) -> DataFrame:
        """centroid(c, embedding): fixed cells for the probing search, the first 8 vectors of each label."""
        e = self.table("embeddings")
        nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
        return e.withColumn("nth", nth).where(F.col("nth") <= 8).select(F.col("vec_id").alias("c"), "embedding")

    # ---- documents ----------------------------------------------------------
    def doc(self) -> DataFrame:
        """doc(doc_id, title, abstract): first sentence and the rest."""
        d = self.table("documents")
        pos = F.instr("text", ".")
        return d.select(
            "doc_id",
            F.when(pos > 0, F.expr("substring(text, 1, instr(text, '.'))"))
             .otherwise(F.col("text")).alias("title"),
            F.when(pos > 0, F.expr("substring(text, instr(text, '.') + 1)"))
             .otherwise(F.lit("")).alias("abstract"))

    def user_item(self) -> DataFrame:
        """user_item(user_id, item): who ordered which part."""
        o = self.table("orders").select(F.col("o_orderkey").alias("k"),
                                        F.col("o_custkey").alias("user_id"))
        li = self.table("lineitem").select(F.col("l_orderkey").alias("k"),
                                           F.col("l_partkey").alias("item"))
        return o.join(li, "k").select("user_id", "item").distinct()

    def clicks(self) -> DataFrame:
        """clicks(user_id, kind, item): ordered parts as papers, their sizes as topics, suppliers as reports."""
        o = self.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user_id"))
        li = self.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey")
        size = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("size"))
        item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("bigint").alias("item"))
        kinds = F.array(item("paper", "l_partkey"), item("topic", "size"), item("report", "l_suppkey"))
        return (o.join(li, "k").join(size, "l_partkey").select("user_id", F.explode(kinds).alias("x"))
                 .select("user_id", "x.kind", "x.item").distinct())
