import random
import re
from collections import Counter, defaultdict

import awkward
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.llm import phrase_mining as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "a b c d The the É é x-y 'q' (z) 日本 \0 <P>".split(" ")


def brute(rows, max_words=3, min_count=10, contained=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= contained * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, le, r, n[lang], -score))
    return sorted(out)


def documents(spark):
    r = random.Random(7)
    blank = lambda: r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n"])
    rows = []
    for i in range(150):
        words = [w for _ in range(r.randint(0, 60)) for w in (r.choice([["new", "york", "city"], ["New", "York"], [r.choice(WORDS)], [r.choice(WORDS)]]))]
        rows.append((500 + i, "".join(w + blank() for w in words), r.choice(["en", "en", "en", "und", None]), "s", None))
    return awkward.documents(spark).unionByName(spark.createDataFrame(rows, awkward.SCHEMA), allowMissingColumns=True)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("args", [{}, {"shard_words": 300, "buckets": 7}, {"max_words": 5, "shard_words": 2000, "buckets": 2},
                                  {"max_words": 2, "min_count": 3, "contained": 80, "top": 7}])
def test_rows_match_brute_force(spark, args):
    docs = documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows, **{k: v for k, v in args.items() if k not in ("shard_words", "buckets")})
    got = rows_of(X.collocations(docs, **args))
    assert got == want and {len(r[2].split(" ")) for r in got} >= ({2, 3} if args.get("max_words") != 2 else {2})


def test_query_matches_sql(spark, tmp_dir):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "lang", "text").toArrow())
    want = con.execute(X.ORACLE["op12_phrase_mining"])
    got = X.op12_phrase_mining(spark, tmp_dir)
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got) == sorted(want.fetchall())


def test_empty_tables(spark):
    assert X.collocations(awkward.empty(spark)).collect() == []
    nothing = spark.createDataFrame([(None, "en"), ("", None), (" .,", "en")], "text string, lang string")
    assert X.collocations(nothing).collect() == []
    assert X.collocations(spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def test_a_hot_pair_is_one_row_per_shard(spark):
    docs = spark.range(3000).select(F.lit("en").alias("lang"), F.concat(F.lit("hot pair. w"), F.col("id") % 100).alias("text"))
    got = rows_of(X.collocations(docs, shard_words=1000))
    assert got == [("en", 1, "hot pair", 3000, 3000, 3000, 9000, 1_000_000)]


def test_products_beyond_64_bits_are_exact(spark):
    big = 3_000_000_019
    row = spark.createDataFrame([(big, [big + 5], [big + 7])], "f long, before array<long>, after array<long>")
    assert row.select(X._score(2).alias("c")).first().c.score == 1_000_000 * big * big // ((big + 5) * (big + 7))


@pytest.mark.parametrize("seed", range(4))
def test_intervals_of_both_transforms_agree(seed):
    """Every interval holds the rotations that start with its phrase (in the reverse: with its reverse)."""
    r = np.random.default_rng(seed)
    s = np.concatenate(([0], r.integers(0, 5, 200), [0])).astype(np.uint32)
    depth = 4
    orders = [X.rotations(x, depth) for x in (s, s[::-1])]
    left, right = X.Transform.of(s, 5, depth), X.Transform.of(s[::-1].copy(), 5, depth)

    def check(phrases, lo, ro, n):
        for p, a, b, k in zip(phrases, lo, ro, n):
            for x, order, at, q in ((s, orders[0], a, p), (s[::-1], orders[1], b, p[::-1])):
                starts = order[at:at + k]
                assert all([x[(i + j) % x.size] for j in range(len(q))] == list(q) for i in starts)
            assert k == sum(tuple(s[i:i + len(p)]) == p for i in range(s.size))
    words = [(c,) for c in range(1, 5)]
    lo, ro, n = left.first[1:-1], right.first[1:-1], np.diff(left.first)[1:]
    check(words, lo, ro, n)
    for step in ("left", "right", "left"):
        if step == "left":
            at, c, lo, ro, n = X.extend(left, lo, ro, n)
            words = [(int(y), *words[i]) for i, y in zip(at, c)]
        else:
            at, c, ro, lo, n = X.extend(right, ro, lo, n)
            words = [(*words[i], int(y)) for i, y in zip(at, c)]
        check(words, lo, ro, n)
        assert len(set(words)) == len(words)
