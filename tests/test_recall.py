from pyspark.sql import functions as F

from citeflow import config as C
from citeflow.operators import recall


def test_lists_are_cut_and_ordered(spark, sf_small):
    from citeflow.plans.recall_job import q_recall_all
    df = q_recall_all(spark, sf_small)
    sizes = df.groupBy("followed_id", "pool", "label").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert sizes and all(r["m"] == r["n"] <= 25 for r in sizes)


def test_repeat_through_two_collaborators_is_kept(spark):
    authorship = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "paper_id long, author_id long")
    paper = spark.createDataFrame([(1, None, 5), (2, None, 3)], "paper_id long, ts date, n_citation long")
    pool = spark.createDataFrame([(1,), (2,)], "paper_id long")
    edges = spark.createDataFrame([(99, 10), (99, 11), (99, 12)], "f long, t long")
    lists = recall.recall_lists(authorship, paper, {C.POOL_HIGH: pool},
                                edges=recall.edge_sets(edges, None), sizes={C.POOL_HIGH: 25})
    co = lists.where(F.col("label") == C.LABEL_COOPERATION).orderBy("rank").collect()
    assert [(r["paper_id"], r["author_id"]) for r in co] == [(1, 10), (1, 11), (2, 12)]


def test_followed_names_fallback(spark):
    follow = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (1, 8)], "user_id long, author_id long")
    author = spark.createDataFrame([(5, "En", None), (6, None, "Zh"), (7, None, None), (8, "E", "Z")],
                                   "author_id long, name_en string, name_zh string")
    got = {r["followed_id"]: (r["name_of_followed_author"], r["chinese_name_of_followed_author"])
           for r in recall.followed_names(follow, author).collect()}
    assert got == {5: ("En", "En"), 6: ("Zh", "Zh"), 8: ("E", "Z")}


def test_nested_output(spark, sf_small):
    from citeflow.plans.recall_job import q_recall_nested
    rows = q_recall_nested(spark, sf_small).collect()
    assert rows
    for r in rows:
        for f in r["followed"]:
            p = f["papers"]
            assert p["highly_cited_papers"] or p["latest_papers"]
            for lst in (p["highly_cited_papers"] or [], p["latest_papers"] or []):
                order = [C.LABEL_ORDER[x["label"]] for x in lst]
                assert order == sorted(order)


def test_a_focus_reads_its_own_papers_only(spark, sf_small):
    """One user's job gives that user's part of all users' job, and leaves nothing persisted."""
    from citeflow.plans.recall_job import q_recall_one_user, q_recall_user
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    one = q_recall_one_user(spark, sf_small).collect()
    user = one[0]["user_id"]
    every = q_recall_user(spark, sf_small).where(F.col("user_id") == user).collect()
    assert sorted(map(str, one)) == sorted(map(str, every)) and one
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_nesting_shuffles_the_rows_once(spark):
    from citeflow.sinks.nested import nest_recall
    paper = {"paper_id": "long", "distance": "double", "new": "boolean", "n_citation": "long", "author_id": "long",
             "author_name_en": "string", "author_name_zh": "string", "pv": "long", "zone": "array<string>"}
    schema = ("user_id long, followed_id long, name_of_followed_author string, chinese_name_of_followed_author string, "
              "pool string, label string, rank long, " + ", ".join(f"{c} {t}" for c, t in paper.items()))
    row = lambda u, f, pool, label, rank, p: (u, f, "n", None, pool, label, rank, p, 0.5, False, 1, f, "n", "", 0, [])
    flat = spark.createDataFrame([row(1, 7, "high", "similar_scholar", 1, 30), row(1, 7, "high", "followed_scholar", 2, 20),
                                  row(1, 7, "high", "followed_scholar", 1, 10), row(1, 8, "latest", "followed_scholar", 1, 5)], schema)
    nested = nest_recall(flat)
    assert nested._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = nested.collect()[0]["followed"]
    assert [f.id_of_followed_author for f in got] == [7, 8]
    assert [p.paper_id for p in got[0].papers.highly_cited_papers] == [10, 20, 30] and got[0].papers.latest_papers is None
    assert got[1].papers.highly_cited_papers is None and [p.paper_id for p in got[1].papers.latest_papers] == [5]


def test_authorship_is_read_once_for_all_labels(spark, tmp_dir):
    """The cut lists of a pool are written once; the lists of every label read them, not authorship again."""
    rows = [(p, a) for p in range(40) for a in (p % 7, (p + 1) % 7)]
    spark.createDataFrame(rows, "paper_id long, author_id long").write.parquet(f"{tmp_dir}/authorship")
    authorship = spark.read.parquet(f"{tmp_dir}/authorship")
    paper = spark.createDataFrame([(p, None, p) for p in range(40)], "paper_id long, ts date, n_citation long")
    edges = recall.edge_sets(spark.createDataFrame([(0, 1), (2, 3)], "f long, t long"), spark.createDataFrame([(0, 4)], "f long, t long"))
    lists = recall.recall_lists(authorship, paper, {C.POOL_HIGH: paper.select("paper_id")}, edges=edges, sizes={C.POOL_HIGH: 3})
    assert not any(tmp_dir in f for f in lists.inputFiles())
    got = {}
    for r in lists.orderBy("rank").collect():
        got.setdefault((r["followed_id"], r["label"]), []).append(r["paper_id"])
    best = lambda a: sorted((p for p, x in rows if x == a), reverse=True)[:3]
    assert got == {**{(a, C.LABEL_FOLLOWED): best(a) for a in range(7)}, (0, C.LABEL_COOPERATION): best(1),
                   (2, C.LABEL_COOPERATION): best(3), (0, C.LABEL_SIMILAR): best(4)}
