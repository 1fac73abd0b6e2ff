import numpy as np
import pytest

from citeflow.operators.embed import PAPER_FIELDS, HashingEmbedder, StructuredEmbedder, hashed_features

SCHEMA = "id long, title string, abstract string, concepts array<string>, venue string, authors array<string>, affiliations array<string>"
PAPER = (1, "Graph mining", "Mining of large graphs " * 40, ["graphs", "mining"], "KDD", ["Ann Bell", None, "Bo Ek"], ["MIT", "ETH", None])


def vectors(spark, *papers, **args):
    df = spark.createDataFrame(list(papers), SCHEMA)
    return [np.array(r.vec) for r in StructuredEmbedder(**args).transform_papers(df, "id").collect()]


@pytest.mark.parametrize("field", PAPER_FIELDS)
def test_each_field_moves_the_vector(spark, field):
    at = 1 + list(PAPER_FIELDS).index(field)
    without = PAPER[:at] + (None,) + PAPER[at + 1:]
    a, b = vectors(spark, PAPER, without)
    assert np.abs(a - b).max() > 1e-3 and abs(np.linalg.norm(a) - 1) < 1e-9


def test_field_and_place_count(spark):
    none = (None,) * 4
    swapped = [(1, "ann bell", *none, None), (1, None, "ann bell", *none), (1, None, None, None, None, ["ann bell", "bo ek"], None),
               (1, None, None, None, None, ["bo ek", "ann bell"], None), (1, None, None, None, None, None, ["ann bell", "bo ek"])]
    v = vectors(spark, *swapped)
    for i in range(5):
        for j in range(i):
            assert np.abs(v[i] - v[j]).max() > 1e-3
    assert not vectors(spark, (1, None, None, None, None, None, None))[0].any()
    assert not vectors(spark, (1, "", "", [], "", [None], []))[0].any()


def test_caps_are_off_by_default(spark):
    long = (1, "x1", "word " * 100 + "end", None, None, None, None)
    shorter = (1, "x1", "word " * 100, None, None, None, None)
    a, b = vectors(spark, long, shorter)
    assert np.abs(a - b).max() > 1e-6
    a, b = vectors(spark, long, shorter, caps={"abstract": 100})
    assert (a == b).all()


def test_hashing_adds_up_tokens_row_by_row(spark):
    rows = [(7, "graph Graph nets"), (7, "other words"), (8, None), (9, "! ?")]
    got = HashingEmbedder(dim=16).transform(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.id)] == [7, 7, 8, 9]
    slot, sign = hashed_features(["graph", "nets"], 16, 42)
    want = np.zeros(16)
    want[slot[0]] += 2 * sign[0]
    want[slot[1]] += sign[1]
    want /= np.linalg.norm(want)
    assert any(np.allclose(r.vec, want) for r in got if r.id == 7)
    assert not any(r.vec != [0.0] * 16 for r in got if r.id > 7)


def test_a_batch_is_encoded_some_features_at_a_time():
    import pyarrow as pa
    from citeflow.operators import embed as E
    batch = pa.record_batch([pa.array(range(6)), pa.array([["a"] * 3, [], ["b"] * 9, ["c"], ["d"], ["e"]])], names=["id", "features"])
    parts = [p.column(0).to_pylist() for p in E.feature_slices(batch, 4)]
    assert parts == [[0, 1], [2], [3, 4, 5]]
