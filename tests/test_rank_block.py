import numpy as np
import pandas as pd
import pytest

from citeflow.operators import cell_store as S
from citeflow.operators import knn as K


def _brute(metric, qids, q, cids, c, k, exclude_self):
    out = set()
    for i, v in zip(qids.tolist(), q):
        s = K._exact_scores(metric, np.repeat(v[None], len(c), axis=0), c)
        rows = sorted((x if metric == "l2" else -x, j) for x, j in zip(s.tolist(), cids.tolist()) if not (exclude_self and i == j))
        out |= {(i, j) for _, j in rows[:k]}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("size", [1.0, 1e25, 1e-25])
def test_tiles_give_the_exact_rows_at_any_scale(monkeypatch, metric, size):
    monkeypatch.setattr(K, "ROWS_OF_TILE", 64)
    monkeypatch.setattr(K, "ROWS_AT_ONCE", 16)
    rng = np.random.default_rng(2)
    c = rng.standard_normal((700, 9)) * size
    c[300:340] = c[5]                                    # equal rows: the smallest ids
    ids = rng.permutation(700)
    for exclude in (True, False):
        qid, cid, _ = K.rank_block(metric, ids[:50], c[:50], ids, c, 7, exclude)
        assert len(qid) == 350 and set(zip(qid.tolist(), cid.tolist())) == _brute(metric, ids[:50], c[:50], ids, c, 7, exclude)


def test_a_far_query_is_ranked_where_single_precision_is_not_enough(monkeypatch):
    c = np.random.default_rng(4).standard_normal((3000, 4))
    q = np.full((3, 4), 1e6)
    monkeypatch.setattr(K, "MORE", 1)
    qid, cid, _ = K.rank_block("l2", np.arange(3), q, np.arange(3000), c, 5, False)
    assert set(zip(qid.tolist(), cid.tolist())) == _brute("l2", np.arange(3), q, np.arange(3000), c, 5, False)


def test_cells_score_only_rows_within_the_reach_of_a_query(monkeypatch):
    rng = np.random.default_rng(5)
    x, ids, cell = rng.standard_normal((2000, 8)), np.arange(2000), np.arange(2000) % 40
    every = ((x[:100, None] - x[None]) ** 2).sum(2)
    reach = np.sqrt(np.sort(every, axis=1)[:, 12])
    rows = pd.DataFrame({"cid": ids, "vec": list(x), "far": np.linalg.norm(x, axis=1), "part": cell})
    own = np.linalg.norm(x[:100], axis=1)
    queries = pd.DataFrame({"qid": ids[:100], "qvec": list(x[:100]), "reach": reach, "cells": [np.arange(40)] * 100,
                            "own": [np.full(40, o) for o in own]})
    scored, exact = [], K._exact_scores
    monkeypatch.setattr(K, "_exact_scores", lambda m, q, c: scored.append(len(q)) or exact(m, q, c))
    qid, cid, _ = S._by_cell("l2", 10, True)(queries, rows)
    assert sum(scored) < 100 * 10 * 40 / 10              # ten of every cell before
    assert set(zip(qid.tolist(), cid.tolist())) == _brute("l2", ids[:100], x[:100], ids, x, 10, True)
