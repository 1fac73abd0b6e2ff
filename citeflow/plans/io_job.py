"""Sources, sinks, encoders and collaborative filtering as named queries
(S1, S2, W7, F18, F20, K1, K2, K4-K7, S17, A9, M7-M10, C1)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..fixtures import Fixtures
from ..functions import text as T
from ..functions.vector import concat_vectors
from ..operators import cf, incremental as INC
from ..operators import tfidf as TF
from ..operators.embed import HashingEmbedder, StructuredEmbedder
from ..session import mark_ready, reusable_path, scratch_path, shuffles_removed
from ..sinks import files as FS
from ..sinks.nested import nest_recall, write_recall_json
from ..sources import papers as SP
from . import label_job, recall_job, search_job, text_job

_PAPERS: dict[tuple[str, str], str] = {}

ROWS_AT_ONCE = 10_000_000       # recalled papers of users that are nested and written together, about


def paper_records(fx: Fixtures) -> DataFrame:
    """Paper JSON records from documents, orders and parts, with the edge rows of the
    original feed: German documents carry no text id; pending orders have a
    malformed time."""
    d = text_job.paper_info(fx)
    o = fx.table("orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_orderstatus")
    lang = fx.table("documents").select("doc_id", "lang")
    j = d.join(o, "doc_id", "left").join(lang, "doc_id")
    ts = F.when(F.col("o_orderstatus") == "P", F.lit("pending")) \
          .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return j.select(
        F.when(F.col("lang") != "de", F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("_id"),
        F.col("doc_id").alias("id_of_mysql"), ts.alias("ts"), "title", "abstract", "keywords", "venue",
        F.transform("authors", lambda a: a["name"]).alias("authors"),
        F.transform("authors", lambda a: a["org"]).alias("affiliations"),
        F.year("o_orderdate").alias("year"), "lang")


def paper_files(spark: SparkSession, sf: str) -> str:
    """Two deliveries of paper files plus one torn file; returns the folder.

    first: papers of orders before 2000; second: the rest, plus the English
    papers of the first delivery sent again (they win as later records).
    """
    root, ready = reusable_path(spark, f"papers-{sf}", _PAPERS)
    if ready:
        return root
    fx = Fixtures(spark, sf)
    rec = paper_records(fx).persist()
    cols = ["_id", "id_of_mysql", "ts", "title", "abstract", "keywords", "venue", "authors", "affiliations"]
    first = rec.where(F.col("year") < 2000)
    second = rec.where((F.col("year") >= 2000) | F.col("year").isNull()) \
                .unionByName(first.where(F.col("lang") == "en"))
    first.select(*cols).write.mode("overwrite").json(f"{root}/1")
    second.select(*cols).write.mode("overwrite").json(f"{root}/2")
    torn = rec.orderBy("id_of_mysql").limit(1).select(
        F.expr("substring(to_json(struct(_id, id_of_mysql, ts)), 1, 20)").alias("value"))
    torn.write.mode("overwrite").text(f"{root}/3")
    rec.unpersist()
    mark_ready(spark, root)
    return root


def _raw(spark, sf):
    return SP.read_papers_raw(spark, f"{paper_files(spark, sf)}/*")


def q_scan_papers(spark, sf):
    good, _ = SP.split_corrupt(_raw(spark, sf))
    return SP.keep_identified(good).drop("seq", "file")


def q_scan_corrupt_split(spark, sf):
    _, bad = SP.split_corrupt(_raw(spark, sf))
    return bad.select(F.regexp_extract("file", "/([0-9]+)/[^/]*$", 1).alias("delivery"), "_corrupt_record")


def q_scan_limit(spark, sf):
    """The first 100 kept records by numeric id (the earlier delivery first)."""
    good, _ = SP.split_corrupt(_raw(spark, sf))
    kept = SP.keep_identified(good)
    first = SP.first_n(kept, 100, "id_of_mysql", "seq")
    return first.select("id_of_mysql", "_id", "ts")


def q_ts_epoch(spark, sf):
    o = Fixtures(spark, sf).table("orders")
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("pending")) \
           .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(F.col("o_orderkey").alias("k"), txt.alias("ts_text")) \
            .select("k", "ts_text", T.text_to_epoch("ts_text").alias("epoch"))


def q_topic_fallback(spark, sf):
    p = text_job.paper_info(Fixtures(spark, sf))
    return p.select("doc_id", T.topic_or_unknown("venue").alias("topic"))


def q_recall_json(spark, sf):
    """K1: nested recall written as JSON lines (one object per user) and read back."""
    out = scratch_path(spark, "recall-json")
    flat = recall_job.recall_user_flat(Fixtures(spark, sf))
    write_recall_json(nest_recall(flat), out, slices=max(1, -(-flat.count() // ROWS_AT_ONCE)))
    return spark.read.text(out)


def q_retention_plan(spark, sf):
    """K7: dated outputs of the last week; keep the run day and the two before."""
    fx = Fixtures(spark, sf)
    days = (fx.table("orders").select(F.to_date("o_orderdate").alias("day"))
            .where(F.col("day") > F.date_sub(F.lit(C.AS_OF), 7)).distinct())
    keep = F.col("day") > F.date_sub(F.lit(C.AS_OF), C.RETENTION_DAYS)
    return days.select("day", T.day_tag("day").alias("tag"), keep.alias("keep"))


def q_retention_apply(spark, sf):
    """K7: an output folder for each of the last ten order days, the old ones deleted; what is left."""
    fx = Fixtures(spark, sf)
    root = scratch_path(spark, "dated-outputs")
    day = F.to_date("o_orderdate")
    orders = fx.table("orders").where((day > F.date_sub(F.lit(C.AS_OF), 10)) & (day <= F.lit(C.AS_OF)))
    # one write for all days: the folder of a day is its tag
    staged = f"{root}-staged"
    orders.select("o_orderkey", T.day_tag(day).alias("tag")).write.partitionBy("tag").parquet(staged)
    for name in FS.names(spark, staged):
        if name.startswith("tag="):
            spark.read.parquet(f"{staged}/{name}").write.parquet(f"{root}/{name.removeprefix('tag=')}")
    spark.range(1).write.parquet(f"{root}/models")          # not dated: none of its business
    FS.apply_retention(spark, root, C.AS_OF, C.RETENTION_DAYS)
    left = [n for n in FS.names(spark, root) if not n.startswith(".")]
    return spark.createDataFrame([(n,) for n in left], "name string")


def q_run_counters(spark, sf):
    """One summary row of the run counters (read, new, labelled, active), observed while the jobs write
    their results: each job runs once."""
    fx = Fixtures(spark, sf)
    jobs = [("papers_read", fx.table("documents").select("doc_id")),
            ("papers_new", search_job.q_incremental_new(spark, sf)),
            ("papers_labelled", label_job.strong_match(spark, sf)),
            ("users_active", fx.active())]
    counts = {}
    for name, job in jobs:
        seen = Observation(name)
        job.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(scratch_path(spark, f"run-{name}"))
        counts[name] = seen.get["n"]
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


def encode_papers(fx: Fixtures) -> DataFrame:
    d = fx.doc().select("doc_id", T.paper_text("title", "abstract").alias("text"))
    return HashingEmbedder().transform(d, "doc_id", "text")


def q_encode_papers(spark, sf):
    """M7/M8: encoder vectors of every paper (default hashing encoder)."""
    return encode_papers(Fixtures(spark, sf))


def q_encode_structured(spark, sf):
    """M7: encoder vectors of the papers from all six fields."""
    p = text_job.paper_info(Fixtures(spark, sf))
    p = p.select("doc_id", "title", "abstract", F.col("keywords").alias("concepts"), "venue",
                 F.transform("authors", lambda a: a["name"]).alias("authors"),
                 F.transform("authors", lambda a: a["org"]).alias("affiliations"))
    return StructuredEmbedder().transform_papers(p, "doc_id")


def q_mixed_vectors(spark, sf):
    """M9: encoder vector followed by the 200-dimensional LSA vector of the cleaned title.

    Vocabulary, IDF and components are fixed: fitted on the cleaned abstracts and
    only applied to the titles.
    """
    fx = Fixtures(spark, sf)
    enc = encode_papers(fx)
    cleaned = lambda col: fx.doc().select("doc_id", F.lower(T.clean_text(col)).alias("text"))
    base = cleaned("abstract")
    tf = TF.term_counts(base, ["doc_id"], stopwords=C.STOPWORDS_EN)
    vocab = TF.fit_vocabulary(tf, base.count(), C.LSA_MIN_DF, C.LSA_MAX_DF, C.LSA_MAX_FEATURES)
    idx, v = TF.lsa_fit(TF.weights(tf, vocab, ["doc_id"]), vocab, ["doc_id"], C.MIXED_LSA_COMPONENTS)
    titles = cleaned("title")
    w = TF.weights(TF.term_counts(titles, ["doc_id"], stopwords=C.STOPWORDS_EN), vocab, ["doc_id"])
    lsa = TF.lsa_transform(w, idx, v, ["doc_id"], titles, normalise=False).withColumnRenamed("vec", "lvec")
    return enc.join(lsa, "doc_id").select("doc_id", concat_vectors("vec", "lvec").alias("vec"))


def q_word_vectors(spark, sf):
    """Vocabulary word vectors and the index -> word map."""
    fx = Fixtures(spark, sf)
    words = fx.vocab()
    vecs = HashingEmbedder().transform(words, "word", "word")
    return INC.dense_index(vecs, "word").select("idx", "word", "vec")


def q_vector_append(spark, sf):
    """K4: stored vectors, then the new papers' vectors appended with their record's time, one row per id."""
    fx = Fixtures(spark, sf)
    table = scratch_path(spark, "vectors")
    stored = search_job.stored_vectors(fx)
    INC.append_vectors(stored, table, "hashing")
    new_ids = (search_job.q_incremental_new(spark, sf).select("pid")
               .join(stored.select("pid"), "pid", "left_anti").withColumnRenamed("pid", "doc_id"))
    enc = encode_papers(fx).join(new_ids, "doc_id", "left_semi")
    ts = fx.table("orders").select(F.col("o_orderkey").alias("pid"), F.unix_timestamp("o_orderdate").alias("ts"))
    add = enc.select(F.col("doc_id").alias("pid"), F.col("vec").alias("embedding")).join(ts, "pid", "left")
    INC.append_vectors(add, table, "hashing")
    return spark.read.parquet(table).select("pid", "ts", "model")


def q_vector_save(spark, sf):
    """K5: vectors saved with their dense index; the index -> id map read back."""
    fx = Fixtures(spark, sf)
    path = scratch_path(spark, "vector-save")
    e = fx.table("embeddings").select(F.col("vec_id").alias("pid"), "embedding")
    INC.dense_index(e, "pid").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("idx", "pid")


def q_vector_reload(spark, sf):
    """Reload saved vectors (the cached-embedding branch)."""
    fx = Fixtures(spark, sf)
    path = scratch_path(spark, "vector-cache")
    fx.table("embeddings").select(F.col("vec_id").alias("pid"), "embedding") \
        .write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def q_model_save_load(spark, sf):
    """K6: fitted vocabulary + IDF saved as a table, loaded, applied to new text."""
    fx = Fixtures(spark, sf)
    path = scratch_path(spark, "tfidf-model")
    source = fx.table("documents").select("doc_id", "source")
    d = fx.doc().join(source, "doc_id").select("doc_id", "source", F.lower(F.concat("title", "abstract")).alias("text"))
    old, new = d.where("source <> 'src1'"), d.where("source = 'src1'")
    vocab = TF.fit_vocabulary(TF.term_counts(old, ["doc_id"]), old.count())
    vocab.write.mode("overwrite").parquet(path)
    loaded = spark.read.parquet(path)
    w = TF.weights(TF.term_counts(new, ["doc_id"]), loaded, ["doc_id"], vocab_bounded=False)
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def q_cf_topk(spark, sf):
    """Five most related items of every item from who-bought-what."""
    t = cf.item_topk(Fixtures(spark, sf).user_item(), k=5)
    return t.select("i", "j", F.round("score", 9).alias("score"), "rk")


def q_cf_topk_kinds(spark, sf):
    """Five most related items of every paper, topic and report, each from its own kind."""
    clicks = Fixtures(spark, sf).clicks()
    path = scratch_path(spark, "clicks")
    with shuffles_removed(spark):
        clicks.write.partitionBy("kind").parquet(path)      # a kind reads its own folder
    t = cf.item_topk_by_kind(spark.read.parquet(path), k=5)
    return t.select("kind", "i", "j", F.round("score", 9).alias("score"), "rk")


QUERIES = {
    "scan_papers": q_scan_papers,
    "scan_corrupt_split": q_scan_corrupt_split,
    "scan_limit": q_scan_limit,
    "ts_epoch": q_ts_epoch,
    "topic_fallback": q_topic_fallback,
    "recall_json": q_recall_json,
    "retention_plan": q_retention_plan,
    "retention_apply": q_retention_apply,
    "run_counters": q_run_counters,
    "encode_papers": q_encode_papers,
    "encode_structured": q_encode_structured,
    "mixed_vectors": q_mixed_vectors,
    "word_vectors": q_word_vectors,
    "vector_append": q_vector_append,
    "vector_save": q_vector_save,
    "vector_reload": q_vector_reload,
    "model_save_load": q_model_save_load,
    "cf_topk": q_cf_topk,
    "cf_topk_kinds": q_cf_topk_kinds,
}

_CF = """
        WITH ui AS ({ui}),
        du AS (SELECT kind, user_id, COUNT(*) AS du FROM ui GROUP BY ALL),
        di AS (SELECT kind, item, COUNT(*) AS di FROM ui GROUP BY ALL),
        pr AS (SELECT a.kind, a.item AS i, b.item AS j, SUM(CAST(1.0 AS DOUBLE) / d.du) AS co
               FROM ui a JOIN ui b ON a.kind = b.kind AND a.user_id = b.user_id AND a.item <> b.item
               JOIN du d ON d.kind = a.kind AND d.user_id = a.user_id GROUP BY ALL),
        sc AS (SELECT pr.kind, pr.i, pr.j, pr.co / sqrt(x.di * y.di) AS score
               FROM pr JOIN di x ON x.kind = pr.kind AND x.item = pr.i JOIN di y ON y.kind = pr.kind AND y.item = pr.j)
        SELECT {kind}i, j, ROUND(score, 9) AS score, rk FROM (
          SELECT *, row_number() OVER (PARTITION BY kind, i ORDER BY score DESC, j) AS rk FROM sc)
        WHERE rk <= 5"""

_TS = """CASE WHEN o.o_orderstatus = 'P' THEN 'pending' ELSE strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') END"""
_TOKENS = r"regexp_extract_all(lower({x}), '([\p{{L}}\p{{N}}_]{{2,}})', 1)"


def _encoded(features: str) -> str:
    """(id, vec) from SQL that gives (id, feature, weight); ids without features have a null one."""
    return f"""
        SELECT id, list_transform(raw, lambda x: CASE WHEN size > 0 THEN x / size ELSE 0.0 END) AS vec FROM (
          SELECT id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS size FROM (
            SELECT i.id, list(coalesce(c.v, 0.0) ORDER BY i.slot) AS raw
            FROM (SELECT DISTINCT id, unnest(range(64)) AS slot FROM ({features})) i
            LEFT JOIN (SELECT id, CAST('0x' || substr(md5('42:' || feature), 1, 8) AS BIGINT) % 64 AS slot,
                              SUM(CASE WHEN substr(md5('42:' || feature), 9, 1) < '8' THEN weight ELSE -weight END) AS v
                       FROM ({features}) WHERE feature IS NOT NULL GROUP BY ALL) c ON c.id = i.id AND c.slot = i.slot
            GROUP BY i.id))"""


def _text_features(source: str) -> str:
    """Tokens of (id, text) rows; a row without tokens has a null one."""
    return f"""SELECT id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS feature, 1.0 AS weight
               FROM (SELECT id, {_TOKENS.format(x='text')} AS t FROM ({source}))"""


_PAPER = """
    SELECT d.doc_id, d.title, nullif(d.abstract, '') AS abstract, p.keywords, v.c_mktsegment AS venue, a.authors, a.orgs
    FROM doc d LEFT JOIN (SELECT p_partkey, string_split(p_name, ' ') AS keywords FROM part) p ON p.p_partkey = d.doc_id
    LEFT JOIN (SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) v ON v.o_orderkey = d.doc_id
    LEFT JOIN (SELECT l.l_orderkey, list(a.name_en ORDER BY l.l_linenumber, l.l_suppkey, a.name_en NULLS FIRST, n.n_name) AS authors,
                      list(n.n_name ORDER BY l.l_linenumber, l.l_suppkey, a.name_en NULLS FIRST, n.n_name) AS orgs
               FROM lineitem l LEFT JOIN author a ON a.author_id = l.l_suppkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
               LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY 1) a ON a.l_orderkey = d.doc_id"""


def _field_features(name: str, column: str, is_list: bool) -> str:
    entry = (f"SELECT doc_id, unnest(x) AS item, unnest(range(len(x))) AS place FROM (SELECT doc_id, {column} AS x FROM paper_fields)"
             if is_list else f"SELECT doc_id, {column} AS item, 0 AS place FROM paper_fields")
    token = f"""SELECT doc_id, place, unnest(t) AS tok, unnest(range(len(t))) AS nth
                FROM (SELECT doc_id, place, {_TOKENS.format(x='item')} AS t FROM ({entry}) WHERE item IS NOT NULL)"""
    pos = "place" if is_list else "nth // 64"
    return f"""SELECT doc_id AS id, '{name}:' || tok AS feature, 1.0 AS weight FROM ({token}) UNION ALL
               SELECT doc_id, '{name}#' || CAST({pos} AS VARCHAR) || ':' || tok, 0.5 FROM ({token})"""


_STRUCTURED = " UNION ALL ".join([
    "SELECT doc_id AS id, NULL AS feature, 0.0 AS weight FROM paper_fields",
    *[_field_features(n, c, x) for n, c, x in (("title", "title", False), ("abstract", "abstract", False), ("concepts", "keywords", True),
                                               ("venue", "venue", False), ("authors", "authors", True), ("affiliations", "orgs", True))]])
_ENCODED = _encoded(_text_features("SELECT doc_id AS id, title || abstract AS text FROM doc"))
_TORN = f"""
        SELECT substr('{{' || CASE WHEN d.lang <> 'de' THEN '"_id":"p' || CAST(d.doc_id AS VARCHAR) || '",' ELSE '' END
                      || '"id_of_mysql":' || CAST(d.doc_id AS VARCHAR) || coalesce(',"ts":"' || {_TS} || '"', '') || '}}', 1, 20)
               AS _corrupt_record
        FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id WHERE d.doc_id = (SELECT MIN(doc_id) FROM documents)"""

ORACLE = {
    "scan_papers": f"""
        WITH rec AS (
          SELECT 'p' || CAST(p.doc_id AS VARCHAR) AS _id, p.doc_id AS id_of_mysql, {_TS} AS ts, p.title, p.abstract, p.keywords, p.venue,
                 p.authors, p.orgs AS affiliations, CAST(NULL AS VARCHAR[]) AS tags, year(o.o_orderdate) AS y, s.lang
          FROM ({_PAPER}) p JOIN documents s ON s.doc_id = p.doc_id LEFT JOIN orders o ON o.o_orderkey = p.doc_id WHERE s.lang <> 'de')
        SELECT * EXCLUDE (y, lang) FROM rec
        UNION ALL SELECT * EXCLUDE (y, lang) FROM rec WHERE y < 2000 AND lang = 'en'""",
    "scan_corrupt_split": f"SELECT '3' AS delivery, _corrupt_record FROM ({_TORN})",
    "encode_papers": f"SELECT id AS doc_id, vec FROM ({_ENCODED})",
    "encode_structured": f"WITH paper_fields AS ({_PAPER}) SELECT id AS doc_id, vec FROM ({_encoded(_STRUCTURED)})",
    "word_vectors": f"""
        SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id AS word, vec FROM ({_encoded(_text_features(
            "SELECT word AS id, word AS text FROM vocab"))})""",
    "scan_limit": """
        SELECT id_of_mysql, _id, ts FROM (
          SELECT r.*, row_number() OVER (ORDER BY id_of_mysql, batch) AS n FROM (
            SELECT p.doc_id AS id_of_mysql, 'p' || CAST(p.doc_id AS VARCHAR) AS _id,
                   CASE WHEN o.o_orderstatus = 'P' THEN 'pending' ELSE strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts,
                   CASE WHEN year(o.o_orderdate) < 2000 THEN 1 ELSE 2 END AS batch
            FROM documents p LEFT JOIN orders o ON o.o_orderkey = p.doc_id WHERE p.lang <> 'de'
            UNION ALL
            SELECT p.doc_id, 'p' || CAST(p.doc_id AS VARCHAR),
                   CASE WHEN o.o_orderstatus = 'P' THEN 'pending' ELSE strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') END,
                   2
            FROM documents p JOIN orders o ON o.o_orderkey = p.doc_id
            WHERE p.lang = 'en' AND year(o.o_orderdate) < 2000) r)
        WHERE n <= 100""",
    "ts_epoch": """
        SELECT o_orderkey AS k,
               CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts_text,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS epoch
        FROM orders""",
    "topic_fallback": """
        SELECT d.doc_id, CASE WHEN v.c_mktsegment IS NULL OR trim(v.c_mktsegment) = '' THEN 'unknown'
                              ELSE v.c_mktsegment END AS topic
        FROM documents d LEFT JOIN (SELECT o.o_orderkey AS doc_id, c.c_mktsegment FROM orders o
                                    JOIN customer c ON c.c_custkey = o.o_custkey) v ON v.doc_id = d.doc_id""",
    "retention_plan": """
        SELECT day, strftime(day, '%Y_%m_%d') AS tag, day > DATE '2001-08-01' - 3 AS keep FROM (
          SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders
          WHERE CAST(o_orderdate AS DATE) > DATE '2001-08-01' - 7)""",
    "retention_apply": """
        SELECT strftime(day, '%Y_%m_%d') AS name FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
        WHERE day > DATE '2001-08-01' - 3 AND day <= DATE '2001-08-01' UNION ALL SELECT 'models'""",
    "run_counters": """
        SELECT (SELECT COUNT(*) FROM documents) AS papers_read,
               (SELECT COUNT(*) FROM (
                  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey) x
                WHERE l_orderkey NOT IN (SELECT pid FROM vec WHERE pid > 0)) AS papers_new,
               (SELECT COUNT(*) FROM strong_labels) AS papers_labelled,
               (SELECT COUNT(*) FROM active) AS users_active""",
    "vector_save": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, vec_id AS pid FROM embeddings",
    "vector_append": """
        SELECT pid, ts, 'hashing' AS model FROM vec
        UNION ALL
        SELECT d.doc_id, CAST(epoch(o.o_orderdate) AS BIGINT), 'hashing'
        FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
        WHERE d.doc_id IN (SELECT l_orderkey FROM lineitem) AND d.doc_id NOT IN (SELECT pid FROM vec)""",
    "model_save_load": f"""
        WITH d AS (SELECT x.doc_id, s.source, lower(x.title || x.abstract) AS text FROM doc x JOIN documents s ON s.doc_id = x.doc_id),
        tf AS (SELECT doc_id, source, term, COUNT(*) AS tf FROM (
                 SELECT doc_id, source, unnest({text_job._TOK.format(x='text')}) AS term FROM d) GROUP BY ALL),
        v AS (SELECT term, {text_job._IDF.format(n="(SELECT COUNT(*) FROM d WHERE source <> 'src1')")} AS idf FROM (
                SELECT term, COUNT(*) AS df FROM tf WHERE source <> 'src1' GROUP BY term)),
        w AS (SELECT tf.doc_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN v ON v.term = tf.term WHERE tf.source = 'src1')
        SELECT doc_id, term, ROUND(w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "vector_reload": "SELECT vec_id AS pid, embedding FROM embeddings",
    "cf_topk": _CF.format(kind="", ui="SELECT DISTINCT '' AS kind, o.o_custkey AS user_id, l.l_partkey AS item "
                               "FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"),
    "cf_topk_kinds": _CF.format(kind="kind, ", ui="""
        SELECT DISTINCT o.o_custkey AS user_id, unnest(['paper', 'topic', 'report']) AS kind,
               unnest([l.l_partkey, p.p_size, l.l_suppkey]) AS item
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey"""),
}
