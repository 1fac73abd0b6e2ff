from pyspark.sql import functions as F

from citeflow import config as C
from citeflow.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_format_keyword(spark):
    cases = {"Deep-Learning ": "deep learning", " graph  theory": "graph  theory",
             "-x-": "x", "\tTab-Case\n": "tab case"}
    for raw, want in cases.items():
        assert one(spark, T.format_keyword("x"), raw) == want


def test_clean_text(spark):
    assert one(spark, T.clean_text("x"), "$a$ b $c$") == " b "
    # a formula does not span a line break
    assert one(spark, T.clean_text("x"), "x $a\nb$ y") == "x a b y"
    assert one(spark, T.clean_text("x"), "don't stop: 42!") == "don't stop 42 "
    # the URL rule never fires in the original order (D7), but does when asked
    url = "see http://example.com/x now"
    assert "example" in one(spark, T.clean_text("x"), url)
    assert "example" not in one(spark, T.clean_text("x", remove_urls=True), url)


def test_filter_tokens(spark):
    got = one(spark, T.filter_tokens("x", C.STOPWORDS_EN), "The 2021 results of an ab Évolution study")
    assert got == "results évolution study"


def test_tokens_unicode(spark):
    got = one(spark, T.tokens("x"), "Héllo wörld, a x_y 12 b")
    assert got == ["héllo", "wörld", "x_y", "12"]


def test_lsa_text_and_paper_text(spark):
    df = spark.createDataFrame([("Title", "Abs"), ("Done.", None), (None, "Only")], "t string, a string")
    rows = df.select(T.lsa_text("t", "a").alias("l"), T.paper_text("t", "a").alias("p")).collect()
    assert [r["l"] for r in rows] == ["Title.Abs", "Done.", ".Only"]
    assert [r["p"] for r in rows] == ["TitleAbs", "Done.", "Only"]


def test_topic_fallback_and_epoch(spark):
    df = spark.createDataFrame([(None, "2001-01-01 00:00:10"), ("  ", "bad")], "t string, ts string")
    rows = df.select(T.topic_or_unknown("t").alias("t"), T.text_to_epoch("ts").alias("e")).collect()
    assert rows[0]["t"] == "unknown" and rows[1]["t"] == "unknown"
    assert rows[0]["e"] == 978307210 and rows[1]["e"] is None


def test_cleaning_is_one_pass_with_the_results_of_the_original_two(spark):
    import re
    rows = ["", " ", "a_b-c  d", "\t x\u00a0y\u2028z \r\n", "it's $x_1$ 5% \u00e9t\u00e9 \u4e2d\u6587 A9", "__", "Z$ $ $q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("i", T.clean_text("t").alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    two = lambda t: re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9'\s]", " ", re.sub(r"\$.*?\$", "", t), flags=re.ASCII), flags=re.ASCII)
    assert {r.i: r.c for r in df.collect()} == {i: two(t) for i, t in enumerate(rows)}
