import bisect
import hashlib
import re

import awkward
import xxhash

from citeflow.llm import order_minhash as X


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def string_hash(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return signed(seed)


def long_hash(*values):
    """Longs are hashed as 8 bytes, ints as 4."""
    seed = 42
    for v, n in values:
        seed = xxhash.xxh64_intdigest((v & ((1 << 8 * n) - 1)).to_bytes(n, "little"), seed)
    return signed(seed)


def signature(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text)
    n = max(len(tokens) - X.K + 1, min(len(tokens), 1))
    seen, elements = {}, []
    for i in range(n):
        h = string_hash(*tokens[i:i + X.K])
        seen[h] = seen.get(h, -1) + 1
        elements.append((long_hash((h, 8), (seen[h], 4)), i))
    if not elements:
        return [0] * X.SLOTS
    elements.sort()
    out = []
    for slot in range(X.SLOTS):
        start = -(1 << 63) + slot * (1 << 64) // X.SLOTS
        first = bisect.bisect_left(elements, (start,))
        chosen = sorted((p, h) for h, p in (elements[first:first + X.L] + elements)[:min(X.L, len(elements))])
        out.append(long_hash(*[(h, 8) for _, h in chosen]) >> 32)
    return out


def as_text(sig):
    return "".join(f"{v & 0xFFFFFFFF:08X}" for v in sig)


def brute(rows):
    rows = sorted({(i, t or "") for i, t in rows},
                  key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        a, b, c = signature(t), signature(edited), signature(after)
        like = lambda x, y: sum(p == r for p, r in zip(x, y)) / X.SLOTS
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), like(a, b), like(a, c))
    return out


def check(docs, rows):
    got = X.fingerprints(docs).collect()
    want = brute(rows)
    assert sorted([(r.doc_id, *tuple(r)[1:]) for r in got], key=str) == sorted([(i, *want[i, t or ""]) for i, t in rows], key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(docs.repartition(5), [tuple(r) for r in docs.collect()])


def test_awkward_rows_match_brute_force(spark):
    check(awkward.documents(spark), [r[:2] for r in awkward.rows()])


def test_lone_row_and_empty_table(spark):
    check(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string"), [(7, "a b c d e f g h")])
    assert X.fingerprints(awkward.empty(spark)).count() == 0


def test_order_counts_not_only_elements(spark):
    from pyspark.sql import functions as F
    words = [f"word{i} same{i}" for i in range(60)]
    turned = words[30:] + words[:30]
    df = spark.createDataFrame([(" . ".join(words), " . ".join(turned), " . ".join(words[:50]))], "a string, b string, c string")
    sig = df.select(*[X.signature(F.col(c)).alias(c) for c in "abc"])
    ab, ac = sig.select(X.likeness(F.col("a"), F.col("b")), X.likeness(F.col("a"), F.col("c"))).first()
    assert 0 < ab < 0.9 and 0.4 < ac < 1


def test_text_order_holds_beyond_a_million_tokens(spark):
    from pyspark.sql import functions as F
    n = (1 << 20) + 5000
    text = " ".join(f"{i % 700_000:x}" for i in range(n))
    got = spark.range(1).select(X.signature(F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lower(F.hex(i % 700_000))), " ")).alias("s")).first().s
    assert [v & 0xFFFFFFFF for v in got] == [v & 0xFFFFFFFF for v in signature(text)]
