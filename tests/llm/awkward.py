"""Small tables with every awkward case, shared by the tests."""

import random

ENGLISH = ("the of and to in that was with for from his they have this are not but had were one you their what all "
           "there when would other which more about time").split()
GERMAN = "der die und das nicht ist ein mit sich auf für von dem sie eine auch als nach wird bei noch über haben".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))


def rows():
    a, b = prose(ENGLISH, 80, 1), prose(GERMAN, 80, 2)
    near = a.split()
    near[40] = "changed"
    return [
        (1, a, "en", "s1", 1), (2, b, "de", "s2", 1), (3, a.replace(" ", " \t\n"), "en", "s1", 1),       # equal but for white space
        (4, " ".join(near), "en", None, 1), (5, None, "en", "s1", None), (6, "", None, "s2", 0),
        (7, " \t\n", "de", "s2", 3), (8, "word", "en", "s3", 4), (9, "Word", "de", "s3", 4),
        (10, prose(ENGLISH, 30_000, 3), "en", "s1", 1), (11, "x" * 200_000, None, "s9", 1),
        (None, prose(ENGLISH, 50, 4), "en", "s1", 1), (None, None, None, None, None),
        (12, b, "de", "s2", 1), (12, b, "de", "s2", 1), (13, "12 34 !!", "en", "s1", 8), (14, "日本語のテキスト", None, "s4", 8),
        *[(20 + i, prose(ENGLISH if i % 2 else GERMAN, 60, 10 + i), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)],
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
EXTRA = ("key", "size", "turn", "bucket", "queue", "start", "doc", "target", "copy", "words", "pass", "finish", "gone_id", "gone_sha",
         "label", "norm", "digest", "locator", "rep", "band", "h", "component", "id", "sha", "sig", "pid", "mentions", "by", "value")


def documents(spark, extra=True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)]) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, column):
    """Odd ids are 1; texts of even ids from 20 on are German here."""
    data = [(i, i % 2) for i in range(20, 60)] + [(None, 1), (5, None), (12, 0), (12, 1)]
    return spark.createDataFrame(data, f"doc_id long, {column} int")
