import math

from pyspark.sql import functions as F

from citeflow.functions.score import distance, score_int

# golden inputs: (ts, citations) -> distance
GOLDEN = [
    ("0", None, 0.36787944117144233),
    ("1999-01-01", 9000, 0.8187307530779819),
    ("2021-04-10", 10, 0.3928607718433742),
    ("2024-02-29", -1, 0.39589747609409875),
    (None, None, 0.36787944117144233),
]


def test_distance_golden(spark):
    df = spark.createDataFrame(GOLDEN, "ts string, c bigint, want double")
    rows = df.select(distance("ts", "c").alias("d"), "want").collect()
    for r in rows:
        assert math.isclose(r["d"], r["want"], rel_tol=0, abs_tol=1e-15)


def test_distance_monotone(spark):
    rows = spark.createDataFrame(
        [("2010-01-01", c) for c in (0, 5, 500, 7999, 8000, 9000)] +
        [(d, 10) for d in ("2000-01-01", "2005-06-01", "2020-01-01")],
        "ts string, c bigint").select("ts", "c", score_int("ts", "c").alias("s")).collect()
    by_c = [r["s"] for r in rows[:6]]
    assert by_c == sorted(by_c) and by_c[-1] == by_c[-2]  # capped at 8000
    by_d = [r["s"] for r in rows[6:]]
    assert by_d == sorted(by_d)


def test_bad_date_counts_as_zero(spark):
    r = spark.createDataFrame([("not a date", 3)], "ts string, c bigint") \
             .select(score_int("ts", "c").alias("s")).first()
    assert r["s"] == 3
