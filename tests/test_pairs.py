import pytest
from pyspark.sql import functions as F

from citeflow.fixtures import Fixtures
from citeflow.operators import cf, graph


def rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("hot", [1, 2, 3])
def test_coauthor_hot_groups_exact(spark, sf_small, hot):
    a = Fixtures(spark, sf_small).authorship()
    want = rows(graph.coauthor_edges(a, hot=10**9), ["f", "t", "w", "rk"])
    got = rows(graph.coauthor_edges(a, hot=hot), ["f", "t", "w", "rk"])
    assert got == want


def test_coauthor_hot_groups_with_focus(spark, sf_small):
    fx = Fixtures(spark, sf_small)
    focus = spark.createDataFrame([(1,), (4,)], "author_id long")
    want = rows(graph.coauthor_edges(fx.authorship(), hot=10**9, focus=focus), ["f", "t", "w", "rk"])
    got = rows(graph.coauthor_edges(fx.authorship(), hot=2, focus=focus), ["f", "t", "w", "rk"])
    assert got == want and {r[0] for r in got} == {1, 4}


@pytest.mark.parametrize("hot", [3, 10])
def test_cf_hot_users_exact(spark, sf_small, hot):
    ui = Fixtures(spark, sf_small).user_item()
    want = rows(cf.item_topk(ui, 5, hot=10**9), ["i", "j", "score", "rk"])
    got = rows(cf.item_topk(ui, 5, hot=hot), ["i", "j", "score", "rk"])
    assert got == want


def test_one_group_holding_everything(spark):
    # one paper with every author plus a few small papers
    data = [(0, m) for m in range(40)] + [(1, 3), (1, 7), (2, 7), (2, 8), (2, 3)]
    a = spark.createDataFrame(data, "paper_id long, author_id long")
    want = rows(graph.coauthor_edges(a, top=4, hot=10**9), ["f", "t", "w", "rk"])
    got = rows(graph.coauthor_edges(a, top=4, hot=5), ["f", "t", "w", "rk"])
    assert got == want


def test_hot_rows_stay_far_below_all_pairs(spark, sf_small):
    """Every item in its own set of users (distinct signatures): the hot part emits few rows per item."""
    from citeflow.operators import pairs as P
    ui = Fixtures(spark, sf_small).user_item().select(F.col("user_id").alias("g"), F.col("item").alias("m"))
    inc = ui.distinct()
    size = inc.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    heavy = inc.join(size, "g").where("n > 5").withColumn("wg", F.lit(1.0) / F.col("n"))
    deg = inc.groupBy("m").agg(F.count(F.lit(1)).alias("d"))
    none = spark.createDataFrame([], "a bigint, b bigint, wl double")
    made = P._with_hot_groups(none, heavy, deg, 5, None, 256)
    members = heavy.select("m").distinct().count()
    pairs = heavy.alias("x").join(heavy.alias("y"), "g").where("x.m <> y.m").select("x.m", "y.m").distinct().count()
    assert made.count() <= 5 * members * -(-members // 256) and made.count() < 0.25 * pairs


def test_many_ties_keep_the_smallest_ids(spark):
    rows = [(0, m) for m in range(300)]
    a = spark.createDataFrame(rows, "paper_id long, author_id long")
    got = graph.coauthor_edges(a, top=3, hot=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.f, []).append((r.rk, r.t))
    assert [t for _, t in sorted(by[0])] == [1, 2, 3] and [t for _, t in sorted(by[200])] == [0, 1, 2] and len(by) == 300


def test_blocks_meet_only_where_they_share_a_group(spark):
    """Large groups without common members: the rows are members x k, whatever the number of blocks."""
    data = [(g, 1000 * g + m) for g in range(30) for m in range(60)]
    a = spark.createDataFrame(data, "paper_id long, author_id long")
    m = a.select(F.col("paper_id").alias("g"), F.col("author_id").alias("m"))
    from citeflow.operators import pairs as P
    got = P.pair_topk(m, 3, hot=10, block=16)
    assert got.count() == 3 * len(data)
    assert {(r.a // 1000) == (r.b // 1000) for r in got.collect()} == {True}


@pytest.mark.parametrize("block", [4, 64])
def test_light_and_hot_weights_add_up(spark, block):
    """Members that share small and large groups, in few and many blocks."""
    data = [(0, m) for m in range(50)] + [(1, m) for m in range(25, 60)] + [(g, m) for g in range(2, 40) for m in (g % 7, g % 11 + 20, g)]
    m = spark.createDataFrame(data, "g long, m long").distinct()
    from citeflow.operators import pairs as P
    cols = ["a", "b", "W", "score", "rk"]
    want = rows(P.pair_topk(m, 6, "inverse_size", True, hot=10**9), cols)
    assert rows(P.pair_topk(m, 6, "inverse_size", True, hot=8, block=block), cols) == want


def _large(spark, data):
    inc = spark.createDataFrame(data, "g long, m long")
    size = inc.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return inc.join(size, "g").withColumn("wg", F.lit(1.0) / F.col("n"))


def test_a_group_in_many_blocks_makes_a_row_per_member(spark):
    """The rows between tasks grow with the memberships, not with the square of a group's size."""
    from citeflow.operators import pairs as P
    heavy = _large(spark, [(g, (g * 37 + i * 101) % 4000) for g in range(50) for i in range(60)])
    index, blocks, _ = P._numbered(heavy, None, 1, P.WORK)
    assert blocks >= index.count() and P._sent(heavy, index, None, blocks).count() <= heavy.count()


@pytest.mark.parametrize("work", [50, 2000])
def test_members_with_tasks_of_their_own_and_cut_lists(spark, work, monkeypatch):
    """Few members in very many groups, lists in chunks, few pairs at a time: the same pairs."""
    from citeflow.operators import pairs as P
    data = {(g, (g * i) % 23 + i) for g in range(200) for i in range(1, 18)} | {(500, m) for m in range(80)}
    m = spark.createDataFrame(sorted(data), "g long, m long")
    cols = ["a", "b", "W", "score", "rk"]
    want = rows(P.pair_topk(m, 4, "one", True, hot=10**9), cols)
    heavy, cut, whole = P._with_hot_groups, P._sent, P._block_best

    def few_at_once(*args):
        def best(key, met, light):
            P.PAIRS_AT_ONCE = 40
            return whole(*args)(key, met, light)
        return best
    monkeypatch.setattr(P, "_with_hot_groups", lambda *a: heavy(*a, work=work))
    monkeypatch.setattr(P, "_sent", lambda *a: cut(*a, chunk=30))
    monkeypatch.setattr(P, "_block_best", few_at_once)
    assert rows(P.pair_topk(m, 4, "one", True, hot=5), cols) == want


def test_light_groups_are_dealt_by_their_number(spark, monkeypatch):
    """A task pairs about LIGHT memberships, however small Spark finds the partitions."""
    from citeflow.operators import pairs as P
    monkeypatch.setattr(P, "LIGHT", 20)
    m = spark.createDataFrame([(g, (g * 7 + i) % 50) for g in range(100) for i in range(3)], "g long, m long")
    got = P.pair_topk(m, 3)
    assert "hashpartitioning(g" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 15), REPARTITION_BY_NUM" in plan
    monkeypatch.setattr(P, "LIGHT", 10**6)
    cols = ["a", "b", "W", "rk"]
    assert rows(got, cols) == rows(P.pair_topk(m, 3), cols)


def test_light_pairs_are_summed_one_way_round(spark):
    from citeflow.operators import pairs as P
    m = spark.createDataFrame(sorted({(g, (g * 7 + i * i) % 50) for g in range(100) for i in range(4)}), "g long, m long")
    every = m.select("m").distinct()
    cols = ["a", "b", "W", "rk"]
    got = P.pair_topk(m, 3, once=True)
    assert "(a#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Generate explode" in plan
    assert rows(got, cols) == rows(P.pair_topk(m, 3, focus=every), cols) == rows(P.pair_topk(m.unionByName(m), 3), cols)
