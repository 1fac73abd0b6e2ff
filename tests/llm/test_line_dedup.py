import random

import awkward
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.llm import common as C
from citeflow.llm import line_dedup as X

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, min_chars=20):
    """(doc_id, n_lines, n_dropped, text) of each (doc_id, text)."""
    low = -2 ** 63
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(low if i is None else i)
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), low if i is None else i) == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def documents(spark):
    r = random.Random(5)
    shared = ["A line that many documents share", "  a line THAT many documents share\r", "Ünïcode zeilen, zwanzig+", "ünïcode, neunzehn c",
              "only two documents have this line", "\x0b twenty code points x \t", "x" * 3000, "", "   ", "short"]
    rows = []
    for i in range(200, 300):
        lines = [r.choice(shared[:4] + shared[5:]) if r.random() < 0.5 else f"a line of document {i} number {j}" for j in range(r.randint(0, 12))]
        rows.append((i, "\n".join(lines), None, None, None))
    rows += [(300, shared[4], None, None, None), (301, shared[4], None, None, None), (None, shared[0], None, None, None),
             (None, "held by null ids only, a line\nmine", None, None, None), (302, shared[0] + "\n", None, None, None),
             *[(None, "held by null ids only, a line", None, None, None)] * 2, *[(303, "\n".join(shared), None, None, None)] * 3,
             (304, "\n".join(["repeated in one document only"] * 5), None, None, None)]
    return awkward.documents(spark).unionByName(spark.createDataFrame(rows, awkward.SCHEMA), allowMissingColumns=True)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("min_docs,min_chars", [(3, 20), (2, 1), (5, 24)])
def test_rows_match_brute_force(spark, min_docs, min_chars):
    docs = documents(spark)
    got = rows_of(X.line_dedup(docs, min_docs, min_chars), "doc_id", "n_lines", "n_dropped", "text")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], min_docs, min_chars), key=str)
    assert got == want and any(r[2] for r in got)


def test_query_matches_sql(spark, tmp_dir):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = con.execute(X.ORACLE["op11_line_dedup"])
    got = X.op11_line_dedup(spark, tmp_dir)
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got, *got.columns) == sorted(want.fetchall(), key=str)


def test_an_index_serves_other_documents(spark):
    """Lines that the index doesn't know stay."""
    index = X.build_index(documents(spark))
    other = spark.createDataFrame([(1, "a line that many documents share\nnot in any document at all"), (2, None)], "doc_id long, text string")
    assert rows_of(X.drop_lines(other, index), "doc_id", "n_dropped", "text") == [(1, 1, "not in any document at all"), (2, 0, "")]


def test_empty_tables(spark):
    assert X.line_dedup(awkward.empty(spark)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(X.line_dedup(nothing), "doc_id", "n_lines", "n_dropped", "text") == [(1, 1, 0, ""), (2, 1, 0, "")]
    assert X.line_dedup(spark.createDataFrame([(1,)], "doc_id long")).count() == 1


def test_a_hot_line_is_one_row_per_task_and_shard(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the very same line in all documents").alias("text")).repartition(4)
    blocks = C.pick(docs, doc_id="long", text="string").mapInArrow(X._blocks(4, 20), X._BLOCK)
    assert blocks.count() == 4
    got = X.line_dedup(docs).groupBy("n_dropped").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 3999)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 60_000])
def test_the_hash_is_perfect_and_minimal(n):
    r = np.random.default_rng(n)
    h1, h2 = (r.integers(0, 2 ** 64, n, np.uint64) for _ in range(2))
    h1[: n // 3] = h1[:1].repeat(n // 3)                 # many equal first halves
    hash_ = X.PerfectHash.build(h1, h2)
    assert sorted(hash_.slots(h1, h2).tolist()) == list(range(n))
    if n >= 1000:
        assert (hash_.words.nbytes + hash_.ranks.nbytes) * 8 < 6 * n
        other = hash_.slots(h2, h1)
        assert ((other >= -1) & (other < n)).all()


def test_counts_are_whole(tmp_path):
    """A shard keeps counts of any size, and the largest holder."""
    h1, h2 = np.array([5, 9], np.uint64), np.array([1, 2], np.uint64)
    import pyarrow as pa
    t = pa.table({"hashes": [np.stack((h1, h2), 1).tobytes()] * 2, "counts": [np.array([70_000, 1]).tobytes()] * 2,
                  "holders": [np.array([3, -4]).tobytes(), np.array([8, -9]).tobytes()]})
    X._build(str(tmp_path))((pa.scalar(0, pa.int32()),), t)
    shard = X.Shard(*X._map(X._path(str(tmp_path), 0)))
    count, holder = shard.find(h1, h2)
    assert count.tolist() == [140_000, 2] and holder.tolist() == [8, -4]
