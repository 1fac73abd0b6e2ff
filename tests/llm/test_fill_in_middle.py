import hashlib
import re

import awkward
import duckdb
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from citeflow.llm import fill_in_middle as X

TRICKY = ["a\nb\nc", "a\nb\nc\n", "\n", "\n\n\n", "one line", "é\n日本\r\nx", "has <P> in it\nb", "b <M\n> c", "x<\nP>\n<", "<S>", "a\0b\n\0"]


def documents(spark):
    more = spark.createDataFrame([(100 + 10 * j + i, t, None, None, None) for j in range(6) for i, t in enumerate(TRICKY)],
                                 awkward.SCHEMA)
    return awkward.documents(spark).unionByName(more, allowMissingColumns=True)


def brute(doc_id, text, rate=100, spm=50):
    """(n, form, prefix, middle, output) by a loop over lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    u = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:u[0]]), "".join(lines[u[0]:u[1]]), "".join(lines[u[1]:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (40, 100), (0, 50)])
def test_rows_match_a_loop_over_lines(spark, rate, spm):
    docs = documents(spark)
    out = X.fill_in_middle(docs, rate=rate, spm=spm)
    got = [tuple(r) for r in out.collect()]
    want = [(r.doc_id, *brute(r.doc_id, r.text, rate, spm)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = out.select("doc_id", X.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    if rate == 100:
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_query_matches_sql(spark, tmp_dir):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    got = X.op13_fill_in_middle(spark, tmp_dir)
    want = con.execute(X.ORACLE["op13_fill_in_middle"])
    names = [c[0] for c in want.description]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.where("output_sha256 = restored_sha256 and form <> 'plain'").count() == 0


def test_other_units_and_sentinels(spark):
    docs = spark.createDataFrame([(i, "w1 w2  w3 " * i) for i in range(30)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = X.fill_in_middle(docs, unit=r"\s*+\S++|\s++", sentinels=marks)
    back = out.select("doc_id", "n", X.restored(F.col("output"), F.col("form"), marks).alias("text")).orderBy("doc_id").collect()
    assert [(r.n, r.text) for r in back] == [(3 * i + (i > 0), "w1 w2  w3 " * i) for i in range(30)]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<PRE>", "RE", "<M>"), ("<a", "a>", "<M>")])
def test_overlapping_sentinels_are_refused(spark, marks):
    with pytest.raises(ValueError):
        X.fill_in_middle(awkward.empty(spark), sentinels=marks)


def test_empty_table(spark):
    assert X.fill_in_middle(awkward.empty(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n é\r", max_size=40))
def test_ends_are_those_of_the_plain_pattern(text):
    ends = regex.fullmatch(f"({X.LINES})*+", text).ends(1)
    assert ends == [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
