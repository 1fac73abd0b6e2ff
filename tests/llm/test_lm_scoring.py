import math
import re
import zlib
from collections import Counter

import awkward
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from citeflow.llm import lm_scoring as X


def words(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] + ["</s>"]


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [words(t) for i, t in rows if not held(i)]
    c = Counter(w for s in train for w in s)
    n, v = sum(c.values()), len(c)
    pairs = Counter((a, b) for s in train for a, b in zip(["<s>", *s], s))
    total, kinds, follows = Counter(), {}, Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        kinds.setdefault(a, [0, 0, 0])[min(k, 3) - 1] += 1
        follows[b] += 1
    d2, d1 = (X.discounts([sum(x == j for x in t.values()) for j in (1, 2, 3, 4)]) for t in (pairs, follows))
    less = lambda k, d: k - d[min(k, 3) - 1] if k else 0

    def p(a, b):
        low = (less(follows[b], d1) + sum(d1[min(k, 3) - 1] for k in follows.values()) / (v + 1)) / len(pairs) if pairs else 1 / (v + 1)
        return less(pairs[a, b], d2) / total[a] + sum(x * y for x, y in zip(d2, kinds[a])) / total[a] * low if total[a] else low
    out = []
    for i, t in rows:
        s = words(t)
        out.append((i, held(i), len(s), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s),
                    sum(math.log10(p(a, b)) for a, b in zip(["<s>", *s], s))))
    return out


def check(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_documents_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    check(X.op8_lm_scoring(spark, sf).collect(),
          [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def run(docs):
    return X.score(docs, X.train(X._folds(docs).where("not held_out").select("text"))).collect()


def test_awkward_rows_match_brute_force(spark):
    check(run(awkward.documents(spark)), [r[:2] for r in awkward.rows()])


def test_hot_contexts_are_dealt_out_without_change(spark, monkeypatch):
    rows = [(i, "the a the b the c the d" if i % 2 else f"the w{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(X, "HOT", 16)
    # tasks import the module anew, so the parameter is given to them by value
    context, word, count = np.full(64, 7), np.arange(64), np.full(64, 1000)
    assert len(set(X._shard_of(context, word, count, 64).tolist())) > 16
    monkeypatch.undo()
    check(run(docs), rows)


def test_no_training_text(spark):
    assert run(awkward.empty(spark)) == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = run(spark.createDataFrame([(held, "a b")], "doc_id long, text string"))[0]
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_a_folder_that_workers_cannot_map_is_refused(spark, monkeypatch):
    monkeypatch.setattr(X.C, "ensure_checkpoint_dir", lambda s: "hdfs://nowhere/x")
    with pytest.raises(ValueError):
        X._folder(spark)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50, unique=True))
def test_blocks_round_trip(values):
    a = np.sort(np.array(values, np.uint64))
    assert (X.unsqueeze(X.squeeze(a)) == a).all() and (X.unplanes(X.planes(a)) == a).all()
