"""Operator 13: fill-in-the-middle transformation by repeated-capture matching.

* Units. One ``fullmatch`` of ``(unit)*`` by the regex library retains every
  repetition of the group: ``match.ends(1)`` has one offset (in code points) per
  unit, so it gives the number of units and both cuts without a loop over units.
  The pattern is possessive: a text is read once and nothing is kept to go back to.
* Cuts. h1 to h4 are the first four 8-digit groups of the sha256 of ``seed:doc_id``.
  The prefix ends after the smaller of h1 and h2 modulo (units + 1), the middle after
  the larger; the suffix is the rest. h3 decides whether a text is transformed, h4 its
  form: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
* ``restored`` rebuilds the text from output and form. The sentinels may not overlap
  each other (an error), and a text that contains one stays plain, so each is found
  where it was put.

Rows: a null or empty text is plain, with 0 units; a null id counts as the empty
text in the draw; rows that repeat an id are drawn alike and cut by their own text;
an empty table gives an empty result. Texts are handled one by one and whole; only
the columns ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LINES = r"[^\n]*+\n|[^\n]++"        # a unit: a line with its end, or a last line without one
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = "7", 100, 50      # per cent of texts transformed, and of these in form spm
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: str, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def cuts(ends: list[int], h1: int, h2: int) -> tuple[int, int]:
    """Where prefix and middle end, from the ends of all units."""
    first, second = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return ends[first - 1] if first else 0, ends[second - 1] if second else 0


def _check(sentinels: tuple[str, str, str]) -> None:
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or i != j and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels must not overlap: {a!r}, {b!r}")


def _transform(seed: str, rate: int, spm: int, unit: str, sentinels: tuple[str, str, str]):
    p, s, m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*+")
        for batch in batches:
            for part in C.slices(batch):
                out = ([], [], [], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), pc.fill_null(part.column(1), "").to_pylist()):
                    ends = units.fullmatch(text).ends(1)
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    if not text or p in text or s in text or m in text or h3 % 100 >= rate:
                        row = len(ends), "plain", None, None, text
                    else:
                        a, b = cuts(ends, h1, h2)
                        if h4 % 100 < spm:
                            row = len(ends), "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
                        else:
                            row = len(ends), "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM, unit: str = LINES,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars (null if plain), output.

    ``unit`` is a pattern whose repetition matches every text whole.
    """
    _check(sentinels)
    C.prepared(docs.sparkSession)
    d = C.pick(docs, doc_id="long", text="string")
    return d.mapInArrow(C.released(_transform(seed, rate, spm, unit, sentinels)), _SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    p, s, m = (F.lit(x) for x in sentinels)

    def parts(first: str, between: Column) -> tuple[Column, Column, Column]:
        """What lies after the first sentinel, after the one between and after the middle's."""
        head = F.split_part(output, between, F.lit(1))
        rest = F.split_part(output, between, F.lit(2))
        return F.substr(head, F.lit(len(first) + 1)), F.split_part(rest, m, F.lit(1)), F.split_part(rest, m, F.lit(2))

    prefix, suffix, middle = parts(sentinels[0], s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(sentinels[1], p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(C.documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE = {"op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, len(parts) - CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 1 ELSE 0 END AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS u1, greatest(h1 % (n + 1), h2 % (n + 1)) AS u2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (
  SELECT *, CASE WHEN u1 = 0 THEN 0 ELSE least(length(text), length(array_to_string(parts[1:u1], chr(10))) + 1) END AS a,
         CASE WHEN u2 = 0 THEN 0 ELSE least(length(text), length(array_to_string(parts[1:u2], chr(10))) + 1) END AS b FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
              ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM e"""}
