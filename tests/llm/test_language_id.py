import math
import zlib

import awkward
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from citeflow.llm import language_id as X


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = X.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(r.accepted and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_awkward_rows(spark):
    got = X.identify(awkward.documents(spark), X.train(awkward.documents(spark))).collect()
    assert len(got) == len(awkward.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (5, 6, 7, 13):
        assert by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted
    assert by[14].lang_pred in ("de", "en") and not by[14].accepted            # letters of no known language
    assert by[10].lang_pred == "en" and by[10].accepted and by[2].lang_pred == "de"


def test_nothing_to_learn_from(spark):
    assert X.identify(awkward.empty(spark), X.train(awkward.empty(spark))).count() == 0
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    row = X.identify(bare, X.train(bare)).first()
    assert (row.lang_pred, row.score, row.accepted) == ("und", 0.0, False)
    one = spark.createDataFrame([(i, "some text here", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in X.identify(one, X.train(one)).collect()} == {"en"}


def _kneser_ney(texts, order):
    """P(symbol | context) by the textbook recursion over dictionaries."""
    seqs = []
    for t in texts:
        out, space = ["^"] * (order - 1), False
        for k, c in enumerate(t.lower()):
            if c.isalpha():
                out.append(c)
                space = False
            elif not space:
                out.append(" ")
                space = True
        seqs.append(out)
    levels = {n: {} for n in range(1, order + 1)}
    grams = {n: set() for n in range(1, order + 1)}
    for s in seqs:
        for i in range(order - 1, len(s)):
            for n in range(1, order + 1):
                grams[n].add(tuple(s[i - n + 1:i + 1]))
            g = tuple(s[i - order + 1:i + 1])
            levels[order][g] = levels[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    disc = {}
    for n, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    size = len(grams[1])

    def p(g):
        n = len(g)
        c = levels[n]
        low = 1 / (size + 1) if n == 1 else p(g[1:])
        follow = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not follow:
            return low
        return max(c.get(g, 0) - disc[n], 0) / sum(follow) + disc[n] * len(follow) / sum(follow) * low
    return p


def test_probabilities_equal_the_textbook(spark):
    texts = ["abab ba, cab", "bac ab abc"]
    docs = spark.createDataFrame([(3 * i, t, "xx") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string")
    ids = [i for i in range(0, 40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in zip(ids, texts * 2)], "doc_id long, text string, lang string")
    model = X.train(docs, order=3, sample=2)
    order = sorted(zip(ids, texts * 2), key=lambda x: (__import__("hashlib").md5(str(x[0]).encode()).hexdigest(), x[0]))
    p = _kneser_ney([order[0][1], order[2][1]], 3)
    for t in ("abba cab", "zab b", "ab, c"):
        s = ["^", "^"] + list(t.replace(",", ""))
        want = -sum(math.log(p(tuple(s[i - 2:i + 1]))) for i in range(2, len(s))) / (len(s) - 2)
        assert abs(model.scores(pa.array([t]))[0][0, 0] - want) < 1e-4


def test_stage_drops_what_is_rejected(spark):
    docs = awkward.documents(spark)
    out = X.keep_known_languages(spark, docs, "")
    assert out.schema.names == docs.schema.names
    left = {r.doc_id for r in out.collect()}
    assert {1, 2, 10, *range(20, 60)} <= left and not left & {5, 6, 7, 13, 14}


def test_symbols_join_runs_and_mark_starts():
    s, starts, letters = X.symbols(pa.array(["A1b", None, "", "ß  é"]), 3)
    assert bytes(s[:5].astype(np.uint8)) == b"\0\0a b" and starts.tolist() == [0, 5, 7, 9] and letters.tolist() == [2, 0, 0, 2]


def test_fold_uses_no_label_of_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "abc def", "yy" if zlib.crc32(str(i).encode()) % 3 == 1 else "xx") for i in range(30)],
                                 "doc_id long, text string, lang string")
    assert {r.lang_pred for r in X.identify(docs, X.train(docs)).select(F.col("lang_pred")).collect()} == {"xx"}


def test_the_sample_is_bounded_by_rows(spark):
    import pytest
    known = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(known, f"text number {'abcdefgh'[i % 8] * (i % 50)}", "xx") for i in range(1500)] + [(None, "without id", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = X._sample(docs, 20, 2).groupBy("lang").agg(F.count("*").alias("n"), F.max("nth").alias("last")).collect()
    assert sorted(tuple(r) for r in got) == [("xx", 20, 20), ("yy", 1, 1)]          # null ids are learnt from
    with pytest.raises(ValueError):
        X.train(docs, languages=1)


def test_stage_without_texts_keeps_nothing(spark):
    assert X.keep_known_languages(spark, spark.createDataFrame([(1, "en")], "doc_id long, lang string"), "").count() == 0
