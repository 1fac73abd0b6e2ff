import random
import zlib

import awkward
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeflow.llm import packing as X

TOKENIZER = Tokenizer.from_file(X.default_vocabulary())


def want(rows, capacity=4096):
    out = []
    for doc, text in rows:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = np.asarray(ids[k:k + capacity], "<u4")
            out.append((doc, k // capacity, k, part.size, zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(got, rows, capacity=4096):
    assert sorted([tuple(r)[:5] for r in got], key=str) == want(rows, capacity)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_awkward_rows_round_trip(spark):
    got = X.pack(awkward.documents(spark)).collect()
    n = check(got, [r[:2] for r in awkward.rows()])
    assert n <= -(-sum(r.length for r in got) // 4096) + 1


def test_documents_reach_the_lower_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = X.pack(docs.repartition(5)).collect()
    assert check(got, [tuple(r) for r in docs.collect()]) == -(-sum(r.length for r in got) // 4096)


def test_empty_table(spark):
    assert X.pack(awkward.empty(spark)).count() == 0


def test_small_capacity_and_hot_length(spark):
    rows = [(i, "the same words here") for i in range(500)] + [(500 + i, "a") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(X.pack(docs, capacity=16).collect(), rows, 16)


def test_words_in_bulk_equal_the_tokenizer_on_odd_text():
    r = random.Random(1)
    pool = [chr(c) for c in [*range(32, 0x250), *range(0x300, 0x370), *range(0x390, 0x400), 0x1E9E, 0x212B, 0xFB01, 0x3000]] + [" "] * 60
    texts = ["".join(r.choice(pool) for _ in range(300)) for _ in range(60)]
    texts += ["İstanbul ǅ ﬁn", "don't we'll 'S", "<|endoftext|> a<|startoftext|>b <|", "x\x1cy\x85z q", "ΑΣ. ΑΣ ΑΣ,", "日本語。 ツ!", ""]
    encode = X.WordIds(X.default_vocabulary(), cache_words=50)
    for t, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    p = X.plan(counts, 64)
    used = {}
    for n, first, base, each, offset, k in zip(*(p[c].tolist() for c in ("length", "first", "base", "each", "offset")), range(10**9)):
        later = [f for m, f in zip(p["length"].tolist(), p["first"].tolist()) if m == n and f > first]
        for rank in range(first, min(later, default=int(counts[n]))):
            used.setdefault(base + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
    assert sum(map(len, used.values())) == len(lengths)
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    # a simple first-fit by falling length needs at least as many
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + n <= 64:
                bins[i] += n
                break
        else:
            bins.append(n)
    assert len(used) <= len(bins) + 1


def test_tasks_of_other_operators_free_the_encoder_of_a_worker():
    X.word_ids(X.default_vocabulary(), 1000)
    same = lambda batches: batches
    list(X.C.released(same, keeps=True)([]))
    assert X.word_ids(X.default_vocabulary(), 1000) is X.word_ids(X.default_vocabulary(), 1000)
    assert len(X.C._kept) == 1
    list(X.C.released(same)([]))
    assert not X.C._kept
