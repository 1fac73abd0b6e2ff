import re

import awkward
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from citeflow.llm import minhash_dedup as X


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, per_cent):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, width=2, per_cent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in X.near_duplicates(df, width, per_cent).collect()}
    assert got == brute(rows, width, per_cent)
    return got


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_near_copies_that_only_other_copies_link(spark):
    """A chain and a cloud around one text: many bucket mates are below the threshold to the hub."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(150):                                   # copies with few to many edits
        w = list(base)
        for at in r.choice(120, int(r.integers(1, 16)), replace=False):
            w[at] = f"e{i}_{at}" if i % 3 else f"shared{at}"
        rows.append((i, " ".join(w)))
    got = check(spark, rows)
    assert len({c for _, c in got.values()}) > 3


def test_awkward_rows(spark):
    got = X.near_duplicates(awkward.documents(spark), 2, 80).collect()
    assert len(got) == len(awkward.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[3].component_id == 1 and not by[3].kept and by[1].kept
    assert by[4].component_id == 1 and by[12].component_id == 2
    assert by[5].n_shingles == by[6].n_shingles == by[7].n_shingles == 0 and by[5].kept and by[6].component_id == 6
    assert by[9].component_id == 8 and by[8].n_shingles == 1
    assert not any(r.kept for r in got if r.doc_id is None)
    assert X.near_duplicates(awkward.empty(spark)).count() == 0


def test_stage_drops_one_of_a_pair(spark):
    docs = awkward.documents(spark)
    out = X.drop_near_copies(spark, docs, "")
    assert out.schema == docs.schema
    left = {r.doc_id for r in out.collect()}
    assert 1 in left and 3 not in left and 10 in left


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**63), max_size=60), min_size=1, max_size=6))
def test_signatures_equal_the_sequential_definition(sets):
    """Slot minima over whole permutations, element by element, without stopping early."""
    slots = 32
    arrays = [np.sort(np.array(sorted(s), np.uint64)) for s in sets]
    ends = np.cumsum([0, *[a.size for a in arrays]])
    got = X.super_minhash(np.concatenate(arrays) if ends[-1] else np.zeros(0, np.uint64), ends, slots)
    for a, sig in zip(arrays, got):
        want = np.full(slots, np.inf)
        for x in a:
            perm = list(range(slots))
            for j in range(slots):
                k, v = X._step(np.array([x]), j, slots)
                perm[j], perm[k[0]] = perm[k[0]], perm[j]
                want[perm[j]] = min(want[perm[j]], v[0])
        assert (want == sig).all()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sig = X.super_minhash(np.concatenate([a, b]), np.array([0, a.size, a.size + b.size]), 1024)
    true = np.intersect1d(a, b).size / np.union1d(a, b).size
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05


def test_shingle_hashes_tell_texts_apart():
    elements, ends = X.shingle_sets(pa.array(["a b c", "A  b\tc", "ab c", None, "", "b a c"]), 2)
    sets = [set(elements[ends[i]:ends[i + 1]].tolist()) for i in range(6)]
    assert sets[0] == sets[1] and not sets[0] & sets[2] and not sets[3] and not sets[4] and not sets[0] & sets[5]


def test_stage_keeps_one_of_repeated_rows_and_null_ids(spark):
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(9, text("a")), (9, text("a")), (None, text("a") + " more"), (4, text("a") + " end"),
            (None, text("b")), (None, text("b") + " more"), (7, text("c")), (7, text("d")), (None, text("d") + " end"), (None, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text[0]) for r in X.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(4, "a"), (None, "b"), (7, "c"), (7, "d"), (None, "e")], key=str)


def test_each_text_of_a_repeated_id_links(spark):
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " end"), (3, text("b") + " end"), (4, text("c")), (5, text("c")), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in X.near_duplicates(df, 2, 80).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 4, False)]


def test_a_large_group_with_shared_edits_makes_few_pairs(spark, monkeypatch):
    """Many texts share an edit against the hub, are not linked to it, and mostly not to each other."""
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        w = base[:60] + [f"p{j}" for j in range(6)] + base[60:]            # a passage they all share
        for at in r.choice(len(w), 12 if i % 3 else 5, replace=False):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w)))
    made = []
    verified = X.verified

    def counted(pairs, sets, per_cent):
        made.append(pairs.count())
        return verified(pairs, sets, per_cent)
    monkeypatch.setattr(X, "verified", counted)
    check(spark, rows)
    star, *rounds = made
    assert rounds and sum(rounds) < 20 * len(rows) < 0.2 * len(rows) ** 2


def test_groups_keep_only_rows_that_still_have_a_partner(spark):
    entry = lambda edit, doc, x, y: (0, edit, doc, 1, 1, 1, 1, x, y)
    rows = [entry(1, 1, True, True), entry(1, 2, False, True), entry(1, 3, False, True), entry(1, 4, False, False),     # 3 is another component
            entry(2, 1, True, True), entry(2, 2, True, True),                    # one component
            entry(3, 1, False, True), entry(3, 3, False, True)]                  # no x left
    e = spark.createDataFrame(rows, "hub long, edit long, doc long, weight long, over long, size long, at int, is_x boolean, is_y boolean")
    comp = spark.createDataFrame([(2, 1)], "id long, component long")
    got = sorted((r.edit, r.doc, r.comp, r.is_x, r.is_y) for r in X._open(e, comp).collect())
    assert got == [(1, 1, 1, True, False), (1, 3, 3, False, True)]


def test_rounds_write_a_group_once_and_pair_every_x(spark, monkeypatch):
    """Without new links the rows of a group are neither joined nor written again, however many rounds there are."""
    n = 300
    rows = [(0, 7, d, 1, 1, 10, 1, d % 2 == 0, True) for d in range(n)]
    e = spark.createDataFrame(rows, "hub long, edit long, doc long, weight long, over long, size long, at int, is_x boolean, is_y boolean")
    none = spark.createDataFrame([], "a long, b long")
    written, met = [], []
    scratch = X.C.scratch

    def counted(df, name):
        out = scratch(df, name)
        written.append((name, out.count()))
        return out

    def unlinked(pairs, sets, per_cent):
        met.append({tuple(r) for r in pairs.collect()})
        return none
    monkeypatch.setattr(X.C, "scratch", counted)
    monkeypatch.setattr(X, "verified", unlinked)
    assert X.across(e, none, none, 80).count() == 0
    assert len(met) > 1 and len(met[0]) < 40 * n
    assert set().union(*met) == {(a, b) for a in range(n) for b in range(a + 1, n) if a % 2 == 0 or b % 2 == 0}
    assert sum(k for name, k in written if name in ("near-groups", "near-taken")) == n
