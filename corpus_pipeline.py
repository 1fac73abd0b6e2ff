"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder
(``spark.checkpoint.dir``) and hands the written table to the next stage, so a
stage works on all that its predecessor kept and lost executors cost at most one
stage. All stages but the last return the columns of ``documents``.

1. language: rows whose language the character model rejects go.
2. exact: of equal texts (white space aside) the row with the smallest id stays.
3. near: of each near-duplicate group (5 words, similarity 0.8) one document stays.
4. mix: sources are mixed to their target weights; a document taken twice is two rows.
5. pack: documents are tokenised and packed into sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm import common, exact_dedup, language_id, minhash_dedup, mixing, packing

STAGES = [
    ("language", language_id.keep_known_languages),
    ("exact", exact_dedup.drop_copies),
    ("near", minhash_dedup.drop_near_copies),
    ("mix", mixing.mix_sources),
    ("pack", packing.pack_documents),
]

# The language model, the near-duplicate signatures and the tokenizer are beyond SQL;
# tests/llm/test_pipeline.py runs the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

