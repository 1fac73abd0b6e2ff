import awkward
import numpy as np
import pyarrow as pa

from citeflow.llm import quality as X


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = X.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_scores_equal_the_closed_form():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(0, 1, (60, 3)), r.normal(1, [1, 2, 0.5], (40, 3))])
    y = np.r_[np.zeros(60), np.ones(40)]
    model = X.Discriminant(x, y, 0.2)
    pooled = sum(((g - g.mean(0)) ** 2).sum(0) for g in (x[:60], x[60:])) / 100
    logs = []
    for g, p in ((x[:60], 0.6), (x[60:], 0.4)):
        cov = 0.8 * np.cov(g.T, bias=True) + np.diag(0.2 * pooled + 1e-4)
        d = x - g.mean(0)
        logs.append(np.log(p) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_equal_a_plain_count():
    texts = ["AÉb !! a a\na a\n| x 12.", None, "", "\n\n", "one one one", "z" * 5000]
    got = X.statistics(pa.array(texts))
    for t, row in zip(texts, got):
        t = t or ""
        w = t.lower().split()
        chars, words = max(len(t), 1), max(len(w), 1)
        lines = [x for x in t.split("\n") if x]
        rate = lambda a, b: np.log(0.002 + a / b)
        want = [np.log1p(len(w)), rate(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÉ" for c in t), chars), rate(sum(c.isdigit() for c in t), chars),
                rate(sum(c in "!?" for c in t), words), rate(t.count("|"), words), rate(sum(a == b for a, b in zip(w, w[1:])), words),
                np.log(len(set(w)) / words + 0.01), rate(len(lines) - len({x.lower() for x in lines}), max(len(lines), 1))]
        names = ("words", "upper", "digit", "shout", "bar", "repeated_neighbours", "distinct_words", "repeated_lines")
        assert np.allclose(row[[X.FEATURES.index(n) for n in names]], want)


def test_awkward_rows(spark):
    docs, labels = awkward.documents(spark), awkward.labels(spark, "quality")
    got = X.classify(docs, X.fit(docs, labels)).collect()
    assert len(got) == len(awkward.rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = X.fit(awkward.empty(spark), labels)
    assert {r.score for r in X.classify(docs, none).collect()} == {0.5}
    one = X.fit(docs, labels.where("quality = 1 and doc_id between 21 and 40"))
    assert {r.score for r in X.classify(docs, one).collect()} == {1.0}
    assert X.classify(awkward.empty(spark), none).count() == 0


def test_the_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i % 300}") for i in range(1200)] + [(2, None), (2, ""), (3, "c")],
                                 "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id long, quality int")
    every = X.C.labelled_sample(docs, labels, "quality", 10 ** 6, 10 ** 6, 1000, "t").collect()
    assert len(every) == 302 and sorted(r.text for r in every if r.label == 0) == [""]
    assert X.C.labelled_sample(docs, labels, "quality", 10 ** 6, 10 ** 6, 40, "t").count() == 40
