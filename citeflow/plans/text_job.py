"""Text cleaning, TF-IDF, LSA and word vectors as named queries.

Documents come from the ``documents`` table: the title is the text up to
and with its first '.', the abstract the rest. Paper-info records (with
nullable fields) are assembled from documents, parts, line items and
suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as C
from ..fixtures import Fixtures
from ..functions import text as T
from ..operators import lsa_blocks as LB
from ..operators import paragraph as PV
from ..operators import tfidf as TF
from ..operators.incremental import dense_index
from ..session import cut_lineage, remove_path, scratch_path, shuffles_removed, stored, written

R = 6


def lsa_docs(fx: Fixtures) -> DataFrame:
    """lower-cased title and abstract as two documents ``(doc_id, part, text)``."""
    d = fx.doc()
    return d.select("doc_id", F.expr("stack(2, 0, lower(title), 1, lower(abstract)) as (part, text)")) \
            .select("doc_id", F.col("part").cast("bigint").alias("part"), "text")


def _tfidf(fx: Fixtures):
    docs = lsa_docs(fx)
    n = docs.count()   # one scalar to the driver
    tf = TF.term_counts(docs, ["doc_id", "part"], stopwords=C.STOPWORDS_EN)
    vocab = TF.fit_vocabulary(tf, n, C.LSA_MIN_DF, C.LSA_MAX_DF, C.LSA_MAX_FEATURES)
    return docs, tf, vocab, n


def paper_info(fx: Fixtures) -> DataFrame:
    """Paper records with optional fields, one per document.

    keywords: the matching part's name words (absent without a part);
    keywords_more: ``{p_type: p_brand}``; authors: ``{name, org}`` of the
    order's suppliers (name absent without an English name, org = nation);
    venue: the ordering customer's segment (absent without an order).
    """
    d = fx.doc().withColumn("abstract", F.when(F.col("abstract") != "", F.col("abstract")))
    part = fx.table("part").select(
        F.col("p_partkey").alias("doc_id"),
        F.split("p_name", " ").alias("keywords"),
        F.create_map("p_type", "p_brand").alias("keywords_more"))
    a = fx.author().select(F.col("author_id").alias("l_suppkey"), "name_en")
    nat = fx.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey") \
            .join(fx.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"),
                  "s_nationkey")
    # only the line items and orders of documents are joined and gathered
    ids = fx.table("documents").select("doc_id")
    lines = fx.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_suppkey", "l_linenumber").join(ids, "doc_id", "left_semi")
    auth = (lines.join(a, "l_suppkey", "left").join(nat, "l_suppkey", "left")
            .groupBy("doc_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "name_en", "n_name"))),
                             lambda x: F.struct(x["name_en"].alias("name"), x["n_name"].alias("org")))
                 .alias("authors")))
    venue = fx.table("orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey").join(ids, "doc_id", "left_semi") \
        .join(fx.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey") \
        .select("doc_id", F.col("c_mktsegment").alias("venue"))
    return (d.join(part, "doc_id", "left").join(auth, "doc_id", "left").join(venue, "doc_id", "left")
            .select("doc_id", "title", "abstract", "keywords", "keywords_more", "authors", "venue"))


def lemma_table(words: DataFrame) -> DataFrame:
    """F10 re-aimed: ``(form, lemma)`` pairs where a plural form's stem is itself a word."""
    w = words.select(F.col("term").alias("form")).distinct()
    stem = w.where(F.col("form").endswith("s") & (F.length("form") > 3)) \
            .withColumn("lemma", F.expr("substring(form, 1, length(form) - 1)"))
    return stem.join(w.select(F.col("form").alias("lemma")), "lemma", "left_semi").select("form", "lemma")


def clean_tokens(df: DataFrame, id_col: str, text_col: str, lemmas: DataFrame) -> DataFrame:
    """F6 -> F7 -> F10 -> F9: cleaned, lemmatised, filtered tokens ``(id, pos, term)``."""
    c = df.select(id_col, T.clean_text(text_col).alias("t"))
    toks = c.select(id_col, F.posexplode(F.split(F.trim("t"), " ")).alias("pos", "form")) \
            .where(F.col("form") != "")
    lem = toks.join(lemmas, "form", "left").select(
        id_col, "pos", F.lower(F.coalesce("lemma", "form")).alias("term"))
    stop = df.sparkSession.createDataFrame([(w,) for w in C.STOPWORDS_EN], "term string")
    kept = lem.where((F.length("term") > 2) & ~F.col("term").rlike("^[0-9]+$"))
    return kept.join(F.broadcast(stop), "term", "left_anti")


# ---- named queries -----------------------------------------------------------

def q_paper_text(spark, sf):
    d = Fixtures(spark, sf).doc()
    return d.select("doc_id", F.md5(T.paper_text("title", "abstract")).alias("h"))


def q_lsa_text(spark, sf):
    d = Fixtures(spark, sf).doc()
    return d.select("doc_id", F.md5(T.lsa_text("title", "abstract")).alias("h"))


def q_tfidf_text(spark, sf):
    p = paper_info(Fixtures(spark, sf))
    return p.select("doc_id", F.md5(T.tfidf_text("title", "abstract", "keywords")).alias("h"))


def q_text_clean(spark, sf):
    d = Fixtures(spark, sf).table("documents")
    return d.select("doc_id", F.md5(T.clean_text("text")).alias("h"))


def q_text_clean_urls(spark, sf):
    d = Fixtures(spark, sf).table("documents")
    return d.select("doc_id", F.md5(T.clean_text("text", remove_urls=True)).alias("h"))


def q_token_filter(spark, sf):
    d = Fixtures(spark, sf).table("documents")
    return d.select("doc_id", F.md5(T.filter_tokens(T.clean_text("text"), C.STOPWORDS_EN)).alias("h"))


def q_tokenise(spark, sf):
    d = Fixtures(spark, sf).table("documents")
    tf = TF.term_counts(d, ["doc_id"], text_col="text")
    return tf.groupBy("term").agg(F.sum("tf").alias("n"))


def q_lsa_docs(spark, sf):
    return lsa_docs(Fixtures(spark, sf)).select("doc_id", "part", F.md5("text").alias("h"))


def q_lemma_join(spark, sf):
    fx = Fixtures(spark, sf)
    d = fx.table("documents")
    words = d.select(F.explode(F.split(F.trim(T.clean_text("text")), " ")).alias("term")) \
             .where(F.col("term") != "")
    toks = clean_tokens(d, "doc_id", "text", lemma_table(words))
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def q_tfidf_idf(spark, sf):
    _, _, vocab, _ = _tfidf(Fixtures(spark, sf))
    return vocab.select("term", "df", F.round("idf", R).alias("idf"))


def q_tfidf_vocab(spark, sf):
    _, _, vocab, _ = _tfidf(Fixtures(spark, sf))
    return vocab.select("term", "df", "total")


def q_tfidf_weights(spark, sf):
    _, tf, vocab, _ = _tfidf(Fixtures(spark, sf))
    w = TF.weights(tf, vocab, ["doc_id", "part"])
    return w.select("doc_id", "part", "term", F.round("weight", R).alias("weight"))


def q_tfidf_fixed_vocab(spark, sf):
    """M2: vocabulary and IDF fitted on the abstracts (no pruning), applied to
    the cleaned title+abstract+keywords text; unknown words are ignored."""
    fx = Fixtures(spark, sf)
    d = fx.doc().select("doc_id", F.lower("abstract").alias("text"))
    n = d.count()
    vocab = TF.fit_vocabulary(TF.term_counts(d, ["doc_id"]), n)
    p = paper_info(fx).select("doc_id", T.tfidf_text("title", "abstract", "keywords").alias("t"))
    cleaned = p.select("doc_id", F.lower(T.clean_text("t")).alias("text"))
    tf = TF.term_counts(cleaned, ["doc_id"])
    w = TF.weights(tf, vocab, ["doc_id"], vocab_bounded=False)
    return w.select("doc_id", "term", F.round("weight", R).alias("weight"))


def q_lsa_embed(spark, sf, k: int = C.LSA_COMPONENTS):
    """M3: 100-dimensional normalised LSA vectors of every document part."""
    docs, tf, vocab, _ = _tfidf(Fixtures(spark, sf))
    w = TF.weights(tf, vocab, ["doc_id", "part"])
    idx, v = TF.lsa_fit(w, vocab, ["doc_id", "part"], k)
    return TF.lsa_transform(w, idx, v, ["doc_id", "part"], docs)


def q_lsa_refit(spark, sf):
    """M4: refit on the new texts only (the original 'fine-tune' retrains); here those of one source."""
    fx = Fixtures(spark, sf)
    new = fx.table("documents").where(F.col("source") == "src1").select("doc_id")
    docs = lsa_docs(fx).join(new, "doc_id", "left_semi")
    n = docs.count()
    tf = TF.term_counts(docs, ["doc_id", "part"], stopwords=C.STOPWORDS_EN)
    vocab = TF.fit_vocabulary(tf, n, C.LSA_MIN_DF, C.LSA_MAX_DF, C.LSA_MAX_FEATURES)
    w = TF.weights(tf, vocab, ["doc_id", "part"])
    idx, v = TF.lsa_fit(w, vocab, ["doc_id", "part"], C.LSA_COMPONENTS)
    return TF.lsa_transform(w, idx, v, ["doc_id", "part"], docs)


def q_lsa_model_reuse(spark, sf):
    """K6/M4: a model is trained when none is stored, stored, loaded and applied; a refit on the texts of one
    source becomes a new version, which the second application uses."""
    fx = Fixtures(spark, sf)
    path = scratch_path(spark, "lsa-model")
    docs = lsa_docs(fx)
    new = docs.join(fx.table("documents").where(F.col("source") == "src1").select("doc_id"), "doc_id", "left_semi")

    def fit(d: DataFrame):
        tf = TF.term_counts(d, ["doc_id", "part"], stopwords=C.STOPWORDS_EN)
        vocab = TF.fit_vocabulary(tf, d.count(), C.LSA_MIN_DF, C.LSA_MAX_DF, C.LSA_MAX_FEATURES)
        return vocab, *TF.lsa_fit(TF.weights(tf, vocab, ["doc_id", "part"]), vocab, ["doc_id", "part"], C.LSA_COMPONENTS)

    def apply(step: int) -> DataFrame:
        vocab, idx, v = TF.lsa_model(spark, path, lambda: fit(docs))
        w = TF.weights(TF.term_counts(new, ["doc_id", "part"], stopwords=C.STOPWORDS_EN), vocab, ["doc_id", "part"])
        return TF.lsa_transform(w, idx, v, ["doc_id", "part"], new).select(F.lit(step).alias("version"), "*")
    first = cut_lineage(apply(0))
    TF.save_lsa(path, *fit(new))
    return first.unionByName(apply(1))


# interactions: customers' line items split by order year into three files
def interactions(fx: Fixtures) -> DataFrame:
    o = fx.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    li = fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    j = li.join(o, "l_orderkey")
    split = (F.when(F.year("o_orderdate") < 2000, F.lit(0))
             .when(F.year("o_orderdate") == 2000, F.lit(1)).otherwise(F.lit(2)))
    return j.select(split.alias("split"), F.col("o_custkey").alias("user_id"),
                    F.col("l_partkey").cast("string").alias("item"),
                    F.struct(split.alias("s"), F.col("o_custkey").alias("u"), F.col("o_orderdate").alias("d"),
                             F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
                             F.col("l_partkey").alias("p")).alias("seq"))


def write_interactions(fx: Fixtures, root: str) -> None:
    """S16 layout: per split, one JSON array of records per user per line."""
    it = interactions(fx)
    per_user = (it.groupBy("split", "user_id")
                .agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("r"))
                .select("split", F.to_json(F.transform("r", lambda x: F.struct(
                    F.col("user_id").alias("user"), x["item"].alias("item")))).alias("value")))
    per_user.write.mode("overwrite").partitionBy("split").text(root)


def read_interactions(spark: SparkSession, root: str) -> DataFrame:
    """``(split, user_no, pos, item)`` from the three split files."""
    t = spark.read.format("text").load(root)
    recs = t.select("split", F.from_json("value", "array<struct<user: bigint, item: string>>").alias("r"))
    return recs.select("split", F.posexplode("r").alias("pos", "rec")).select(
        F.col("split").cast("bigint").alias("split"), F.col("rec.user").alias("user_no"),
        F.col("pos").cast("bigint").alias("pos"), F.col("rec.item").alias("item"))


def q_interactions_scan(spark, sf):
    fx = Fixtures(spark, sf)
    root = scratch_path(spark, "interactions")
    write_interactions(fx, root)
    return read_interactions(spark, root)


def lsa_corpus(fx: Fixtures) -> DataFrame:
    """Interacted items that have paper info, each once, numbered by first appearance."""
    it = interactions(fx)
    first = it.groupBy("item").agg(F.min("seq").alias("first"))
    item = F.col("doc_id").cast("string").alias("item")
    # numbered without the texts, which are then dealt once; rows that repeat an id go by their text
    numbered = dense_index(first.join(fx.table("documents").select(item), "item"), "first").select("idx", "item")
    nth = lambda *by: F.row_number().over(Window.partitionBy("item").orderBy(*by))
    info = fx.doc().select(item, "title", "abstract").withColumn("nth", nth("title", "abstract"))
    return (numbered.withColumn("nth", nth("idx")).join(info, ["item", "nth"])
            .select("idx", "item", T.lsa_text("title", "abstract").alias("text")))


def q_lsa_corpus(spark, sf):
    c = lsa_corpus(Fixtures(spark, sf))
    return c.select("idx", "item", F.md5("text").alias("h"))


def q_lsa_pretrain(spark, sf):
    """M5: LSA (no pruning) on the interaction corpus, 100 dimensions; the matrices are tables of blocks."""
    fx = Fixtures(spark, sf)
    with shuffles_removed(spark):
        texts, c = stored(lsa_corpus(fx).select(F.col("idx").alias("doc"), "text"), "lsa-corpus")
        docs = written(c.select("doc"), "lsa-ids")
        counts, tf = stored(TF.term_counts(c, ["doc"]), "lsa-counts")
        remove_path(spark, texts)
        vocab = written(TF.fit_vocabulary(tf, docs.count()), "lsa-vocabulary")
        lay = LB.lay_out(TF.weights(tf, vocab, ["doc"], vocab_bounded=False), ["doc"])
        remove_path(spark, counts)
        v, size = LB.fit(lay, C.LSA_COMPONENTS)
    return LB.transform(lay, v, len(size), ["doc"], docs, normalise=False)


def q_word2vec_embed(spark, sf, vector_size: int = C.W2V_VECTOR_SIZE):
    """M6: word vectors (window 5, min count 5), a document = mean of its words."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    docs = lsa_docs(Fixtures(spark, sf)).select("doc_id", "part", T.tokens("text").alias("words"))
    w2v = Word2Vec(vectorSize=vector_size, windowSize=C.W2V_WINDOW, minCount=C.W2V_MIN_COUNT,
                   seed=42, maxIter=C.W2V_PASSES, inputCol="words", outputCol="v",
                   numPartitions=C.W2V_PARTITIONS)
    model = w2v.fit(docs)
    return model.transform(docs).select("doc_id", "part", vector_to_array("v").alias("vec"))


def q_paragraph_embed(spark, sf, size: int = C.W2V_VECTOR_SIZE):
    """M6: paragraph vectors of every title and abstract, inferred with the model that was fitted on all of them."""
    docs = lsa_docs(Fixtures(spark, sf)).select("doc_id", "part", T.tokens("text").alias("words"))
    model = PV.fit(docs, size, C.W2V_MIN_COUNT, passes=C.W2V_PASSES)
    return PV.infer(docs, model)


def q_clean_nulls(spark, sf):
    """Null text -> '', nulls dropped from arrays."""
    p = paper_info(Fixtures(spark, sf))
    names = F.transform("authors", lambda x: x["name"])
    return p.select("doc_id", F.coalesce("abstract", F.lit("")).alias("abstract"),
                    F.array_compact(names).alias("names"))


def q_paper_defaults(spark, sf):
    """Optional fields defaulted: text -> '', lists -> []."""
    p = paper_info(Fixtures(spark, sf))
    empty = F.array().cast("array<string>")
    return p.select("doc_id",
                    F.coalesce("abstract", F.lit("")).alias("abstract"),
                    F.coalesce("venue", F.lit("")).alias("venue"),
                    F.coalesce("keywords", empty).alias("keywords"),
                    F.size(F.coalesce("authors", F.array())).cast("bigint").alias("n_authors"))


def q_paper_normalise(spark, sf):
    """P5 + P6: author structs -> name and org lists; keywords back-filled from the map keys."""
    p = paper_info(Fixtures(spark, sf))
    kw = F.when(F.col("keywords").isNull() | (F.size("keywords") == 0),
                F.array_sort(F.map_keys("keywords_more"))).otherwise(F.col("keywords"))
    return p.select("doc_id",
                    F.coalesce(kw, F.array().cast("array<string>")).alias("keywords"),
                    F.coalesce(F.array_compact(F.transform("authors", lambda x: x["name"])),
                               F.array().cast("array<string>")).alias("authors"),
                    F.coalesce(F.array_compact(F.transform("authors", lambda x: x["org"])),
                               F.array().cast("array<string>")).alias("affiliations"))


QUERIES = {
    "paper_text": q_paper_text,
    "lsa_text": q_lsa_text,
    "tfidf_text": q_tfidf_text,
    "text_clean": q_text_clean,
    "text_clean_urls": q_text_clean_urls,
    "token_filter": q_token_filter,
    "tokenise": q_tokenise,
    "lsa_docs": q_lsa_docs,
    "lemma_join": q_lemma_join,
    "tfidf_idf": q_tfidf_idf,
    "tfidf_vocab": q_tfidf_vocab,
    "tfidf_weights": q_tfidf_weights,
    "tfidf_fixed_vocab": q_tfidf_fixed_vocab,
    "lsa_embed": q_lsa_embed,
    "lsa_refit": q_lsa_refit,
    "lsa_model_reuse": q_lsa_model_reuse,
    "interactions_scan": q_interactions_scan,
    "lsa_corpus": q_lsa_corpus,
    "lsa_pretrain": q_lsa_pretrain,
    "word2vec_embed": q_word2vec_embed,
    "paragraph_embed": q_paragraph_embed,
    "clean_nulls": q_clean_nulls,
    "paper_defaults": q_paper_defaults,
    "paper_normalise": q_paper_normalise,
}

# ---- oracle -----------------------------------------------------------------
from .oracle_views import VIEWS as _V  # noqa: E402

_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS_EN)
_CLEAN = ("regexp_replace(regexp_replace(regexp_replace({x}, '\\$.*?\\$', '', 'g'), "
          "'[^A-Za-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g')")
_CLEAN_URL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\$.*?\\$', '', 'g'), "
              "'[a-zA-Z]+://[^\\s]*[.com|.cn]', '', 'g'), '[^A-Za-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g')")
_TOK = "regexp_extract_all({x}, '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)"
_IDF = "LN((1.0 + {n}) / (1.0 + df)) + 1.0"

_V.update({
    "doc": """
        SELECT doc_id,
               CASE WHEN strpos(text, '.') > 0 THEN substring(text, 1, strpos(text, '.')) ELSE text END AS title,
               CASE WHEN strpos(text, '.') > 0 THEN substring(text, strpos(text, '.') + 1) ELSE '' END AS abstract
        FROM documents""",
    "ldocs": """
        SELECT doc_id, CAST(0 AS BIGINT) AS part, lower(title) AS text FROM doc
        UNION ALL SELECT doc_id, CAST(1 AS BIGINT), lower(abstract) FROM doc""",
    "ltf": f"""
        SELECT doc_id, part, term, COUNT(*) AS tf FROM (
          SELECT doc_id, part, unnest({_TOK.format(x='text')}) AS term FROM ldocs)
        WHERE term NOT IN ({_STOP}) GROUP BY ALL""",
    "lvocab": f"""
        SELECT term, df, {_IDF.format(n='(SELECT COUNT(*) FROM ldocs)')} AS idf, total FROM (
          SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM ltf GROUP BY term)
        WHERE df >= 2 AND df <= 0.5 * (SELECT COUNT(*) FROM ldocs)
        ORDER BY total DESC, term LIMIT 10000""",
    "pinfo": """
        SELECT d.doc_id, d.title, CASE WHEN d.abstract <> '' THEN d.abstract END AS abstract,
               string_split(p.p_name, ' ') AS keywords, MAP([p.p_type], [p.p_brand]) AS keywords_more,
               au.authors, v.c_mktsegment AS venue
        FROM doc d
        LEFT JOIN part p ON p.p_partkey = d.doc_id
        LEFT JOIN (SELECT l.l_orderkey AS doc_id,
                          list({'name': a.name_en, 'org': n.n_name}
                               ORDER BY l.l_linenumber, l.l_suppkey, a.name_en, n.n_name) AS authors
                   FROM lineitem l LEFT JOIN author a ON a.author_id = l.l_suppkey
                   LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
                   LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
                   GROUP BY l.l_orderkey) au ON au.doc_id = d.doc_id
        LEFT JOIN (SELECT o.o_orderkey AS doc_id, c.c_mktsegment FROM orders o
                   JOIN customer c ON c.c_custkey = o.o_custkey) v ON v.doc_id = d.doc_id""",
    "inter": """
        SELECT CASE WHEN year(o.o_orderdate) < 2000 THEN 0 WHEN year(o.o_orderdate) = 2000 THEN 1 ELSE 2 END AS s,
               o.o_custkey AS u, o.o_orderdate AS d, l.l_orderkey AS k, l.l_linenumber AS n, l.l_partkey AS p,
               CAST(l.l_partkey AS VARCHAR) AS item
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "lcorpus": """
        SELECT row_number() OVER (ORDER BY s, u, d, k, n, p) - 1 AS idx, item,
               CASE WHEN suffix(title, '.') THEN title ELSE title || '.' END || abstract AS text
        FROM (SELECT i.*, row_number() OVER (PARTITION BY item ORDER BY s, u, d, k, n, p) AS r FROM inter i) f
        JOIN doc ON CAST(doc.doc_id AS VARCHAR) = f.item
        WHERE r = 1""",
})

_FILTER = (f"array_to_string(list_filter(string_split(lower({{x}}), ' '), lambda w: length(w) > 2 "
           f"AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{_STOP}], w)), ' ')")

ORACLE = {
    "paper_text": "SELECT doc_id, md5(COALESCE(title, '') || COALESCE(abstract, '')) AS h FROM doc",
    "lsa_text": "SELECT doc_id, md5(CASE WHEN suffix(title, '.') THEN title ELSE title || '.' END || abstract) AS h FROM doc",
    "tfidf_text": "SELECT doc_id, md5(concat_ws(' ', title, abstract, array_to_string(keywords, ' '))) AS h FROM pinfo",
    "text_clean": f"SELECT doc_id, md5({_CLEAN.format(x='text')}) AS h FROM documents",
    "text_clean_urls": f"SELECT doc_id, md5({_CLEAN_URL.format(x='text')}) AS h FROM documents",
    "token_filter": f"SELECT doc_id, md5({_FILTER.format(x=_CLEAN.format(x='text'))}) AS h FROM documents",
    "tokenise": f"""
        SELECT term, COUNT(*) AS n FROM (SELECT unnest({_TOK.format(x='lower(text)')}) AS term FROM documents)
        GROUP BY term""",
    "lsa_docs": "SELECT doc_id, part, md5(text) AS h FROM ldocs",
    "lemma_join": f"""
        WITH toks AS (
          SELECT doc_id, unnest(string_split(trim({_CLEAN.format(x='text')}), ' ')) AS form FROM documents),
        forms AS (SELECT DISTINCT form FROM toks WHERE form <> ''),
        lem AS (SELECT form, substring(form, 1, length(form) - 1) AS lemma FROM forms
                WHERE suffix(form, 's') AND length(form) > 3
                  AND substring(form, 1, length(form) - 1) IN (SELECT form FROM forms)),
        t AS (SELECT lower(COALESCE(l.lemma, k.form)) AS term FROM toks k LEFT JOIN lem l ON l.form = k.form
              WHERE k.form <> '')
        SELECT term, COUNT(*) AS n FROM t
        WHERE length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP})
        GROUP BY term""",
    "tfidf_idf": "SELECT term, df, ROUND(idf, 6) AS idf FROM lvocab",
    "tfidf_vocab": "SELECT term, df, total FROM lvocab",
    "tfidf_weights": """
        SELECT doc_id, part, term, ROUND(w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id, part)), 6) AS weight
        FROM (SELECT t.doc_id, t.part, t.term, t.tf * v.idf AS w FROM ltf t JOIN lvocab v ON v.term = t.term)""",
    "tfidf_fixed_vocab": f"""
        WITH a AS (SELECT doc_id, lower(abstract) AS text FROM doc),
        atf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (
                  SELECT doc_id, unnest({_TOK.format(x='text')}) AS term FROM a) GROUP BY ALL),
        v AS (SELECT term, {_IDF.format(n='(SELECT COUNT(*) FROM a)')} AS idf FROM (
                SELECT term, COUNT(*) AS df FROM atf GROUP BY term)),
        c AS (SELECT doc_id, lower({_CLEAN.format(x="concat_ws(' ', title, abstract, array_to_string(keywords, ' '))")}) AS text
              FROM pinfo),
        ctf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (
                  SELECT doc_id, unnest({_TOK.format(x='text')}) AS term FROM c) GROUP BY ALL),
        w AS (SELECT ctf.doc_id, ctf.term, ctf.tf * v.idf AS w FROM ctf JOIN v ON v.term = ctf.term)
        SELECT doc_id, term, ROUND(w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "interactions_scan": """
        SELECT split, user_no, row_number() OVER (PARTITION BY split, user_no ORDER BY d, k, n, p) - 1 AS pos, CAST(p AS VARCHAR) AS item
        FROM (SELECT CAST(CASE WHEN year(o.o_orderdate) < 2000 THEN 0 WHEN year(o.o_orderdate) = 2000 THEN 1 ELSE 2 END AS BIGINT) AS split,
                     CAST(o.o_custkey AS BIGINT) AS user_no, o.o_orderdate AS d, l.l_orderkey AS k, l.l_linenumber AS n, l.l_partkey AS p
              FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)""",
    "lsa_corpus": "SELECT idx, item, md5(text) AS h FROM lcorpus",
    "clean_nulls": """
        SELECT doc_id, COALESCE(abstract, '') AS abstract,
               list_filter(list_transform(authors, lambda x: x.name), lambda x: x IS NOT NULL) AS names
        FROM pinfo""",
    "paper_defaults": """
        SELECT doc_id, COALESCE(abstract, '') AS abstract, COALESCE(venue, '') AS venue,
               COALESCE(keywords, CAST([] AS VARCHAR[])) AS keywords,
               CAST(COALESCE(len(authors), 0) AS BIGINT) AS n_authors FROM pinfo""",
    "paper_normalise": """
        SELECT doc_id,
               COALESCE(CASE WHEN keywords IS NULL OR len(keywords) = 0 THEN list_sort(map_keys(keywords_more))
                             ELSE keywords END, CAST([] AS VARCHAR[])) AS keywords,
               COALESCE(list_filter(list_transform(authors, lambda x: x.name), lambda x: x IS NOT NULL),
                        CAST([] AS VARCHAR[])) AS authors,
               COALESCE(list_filter(list_transform(authors, lambda x: x.org), lambda x: x IS NOT NULL),
                        CAST([] AS VARCHAR[])) AS affiliations
        FROM pinfo""",
}
