"""The pipeline against brute force, stage by stage, each on its own input."""

import awkward
import corpus_pipeline as P
import test_exact_dedup
import test_minhash_dedup
import test_packing

from citeflow.llm import language_id, mixing


def test_stages_match_brute_force(spark):
    docs = P.common.documents(spark, "/root/testdata/sf0.001")
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    names = [n for n, _ in P.STAGES]
    stage = dict(P.STAGES)
    assert names == ["language", "exact", "near", "mix", "pack"]

    known = P.common.scratch(stage["language"](spark, docs, ""), "t")
    decided = language_id.identify(docs, language_id.train(docs))
    assert sorted(r.doc_id for r in known.collect()) == sorted(r.doc_id for r in decided.where("accepted").collect())

    exact = P.common.scratch(stage["exact"](spark, known, ""), "t")
    assert sorted(i for i, _ in rows(exact)) == sorted(r[0] for r in test_exact_dedup.brute(rows(known)) if r[3])

    near = P.common.scratch(stage["near"](spark, exact, ""), "t")
    assert sorted(i for i, _ in rows(near)) == sorted(i for i, (_, c) in test_minhash_dedup.brute(rows(exact), 5, 80).items() if i == c)

    mixed = P.common.scratch(stage["mix"](spark, near, ""), "t")
    taken = {r.doc_id: r.taken for r in mixing.queued(near).withColumn("taken", mixing._words(0) + mixing._words(1)).collect()}
    got = {}
    for i, t in rows(mixed):
        got[i] = got.get(i, 0) + len(t.split())
    assert got == {i: n for i, n in taken.items() if n}

    packed = stage["pack"](spark, mixed, "").collect()
    test_packing.check(packed, rows(mixed))
    for d in (known, exact, near, mixed):
        assert d.schema == docs.schema
    assert P.run(spark, "/root/testdata/sf0.001").count() == len(packed)


def test_awkward_tables_pass_all_stages(spark):
    for docs in (awkward.documents(spark), awkward.empty(spark)):
        names = docs.columns
        for _, stage in P.STAGES[:-1]:
            docs = P.common.scratch(stage(spark, docs, ""), "t")
            assert docs.columns == names
        assert P.STAGES[-1][1](spark, docs, "").count() >= docs.count()
