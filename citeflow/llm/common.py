"""Helpers shared by the corpus operators.

* input columns: a missing column reads as null, names are matched exactly, so
  extra columns (also with names that operators use inside) never clash;
* scratch tables: written under ``spark.checkpoint.dir`` and read back, which
  cuts lineage and survives the loss of an executor;
* text kernels: numpy over the UTF-8 buffer of an Arrow batch (no Python loop
  over words). A word is a run of bytes outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

SPACE = r"[\x20\x09-\x0D]"          # white space of the contracts, as a Java / RE2 class
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20               # text handled at once inside a task
BATCH_ROWS = "1000"                 # of an Arrow batch: whole texts are long rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; a column the input lacks is null."""
    have = set(docs.columns)
    return docs.select(*[(F.col(f"`{c}`").cast(t) if c in have else F.lit(None).cast(t)).alias(c)
                         for c, t in types.items()])


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder, with its scheme."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{scratch_path(spark, name).rpartition('/')[2]}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, column: str, name: str = "rows") -> DataFrame:
    """``docs`` with a long in ``column`` that is the row's own: its place in the Parquet files.

    The place does not change when the plan is run again; what is not a table of Parquet
    files is written once. The window runs over one row per file.
    """
    file, at, path, turn = unused([*docs.columns, column], "file", "at", "path", "turn")
    own = [F.col(f"`{c}`") for c in docs.columns]
    placed = None
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            placed = docs.select(*own, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
        except AnalysisException:       # another format
            pass
    if placed is None:
        return numbered(scratch(docs, name), column)
    files = scratch(placed.select(F.col(file).alias(path)).distinct().withColumn(
        turn, F.row_number().over(Window.orderBy(path)).cast("long")), name + "-files")
    return placed.join(F.broadcast(files), F.col(file) == F.col(path)).select(
        *own, (F.shiftleft(F.col(turn), 40) + F.col(at)).alias(column))


def with_schema(df: DataFrame, schema) -> DataFrame:
    """``df`` with the schema of the table it came from: columns read back from files have lost their "not null"."""
    if df.schema == schema:
        return df
    spark = df.sparkSession
    session = spark._jsparkSession
    return DataFrame(session.createDataFrame(df._jdf.toJavaRDD(), session.parseDataType(schema.json())), spark)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until the columns don't have them."""
    have = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def prepared(spark: SparkSession) -> None:
    """What every operator with Python tasks needs first."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # documents are long rows: batches of the default size would hold tens of MB, twice per running task
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > int(BATCH_ROWS):
        spark.conf.set(rows, BATCH_ROWS)


def give_back() -> None:
    """Free memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # no glibc
        pass


_kept: dict = {}


def kept(key, make):
    """What a worker, which outlives its tasks, keeps for the next ones: one thing at a time."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def released(run, keeps: bool = False):
    """A batch function after which the worker, which lives on idle, gives free memory back to the system.
    What tasks of another operator kept in it goes at the start, unless the function ``keeps`` things itself."""
    def inner(batches):
        if not keeps:
            forget()
        yield from run(batches)
        give_back()
    return inner


# ---- text kernels -----------------------------------------------------------------
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)      # a random value per byte
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C17                                       # odd, so it has an inverse
_P_INV = np.uint64(pow(_P, -1, 1 << 64))
_P = np.uint64(_P)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """The batch in row slices of about ``limit`` bytes of text each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in ``data``, and the first word of each text (n + 1 places)."""
    if data.size == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~_IS_SPACE[data]
    first = np.zeros(data.size + 1, bool)
    first[off] = True                                   # words never run over two texts
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | first[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | first[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over byte values, from running sums."""
    if s.size == 0:
        return np.zeros(0, np.uint64)
    n = data.size
    up = np.full(n, _P)
    up[0] = 1
    down = np.full(n, _P_INV)
    down[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        up *= _BYTE[_LOWER[data] if lower else data]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(up, out=total[1:])
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * GOLDEN)


# ---- pruning by a bitmap of fixed size --------------------------------------------
BITMAP_BLOCKS, BITMAP_BITS = 1 << 16, 62        # about 4 million bits, 1 MB when broadcast


def _place(key: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(key), F.lit(BITMAP_BLOCKS * BITMAP_BITS))
    return F.floor(h / BITMAP_BITS).cast("int"), F.pmod(h, F.lit(BITMAP_BITS)).cast("int")


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(block, bits): which of a fixed number of hash places the keys fall on.

    At most BITMAP_BLOCKS rows whatever the number of keys, so it may be broadcast.
    """
    block, bit = _place(F.col(key))
    return (keys.select(block.alias("block"), F.expr("shiftleft(1L, 0)").alias("one"), bit.alias("bit"))
                .groupBy("block").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits")))


def maybe_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the bitmap (none is lost)."""
    block, bit = _place(F.col(key))
    b = F.broadcast(bits.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")))
    out = df.withColumn("__at", block).withColumn("__bit", bit)
    return out.join(b, (F.col("__at") == F.col("__block"))
                    & (F.expr("__bits & shiftleft(1L, __bit)") != 0), "left_semi").select(*df.columns)


# ---- labelled samples --------------------------------------------------------------
def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, rows: int,
                    name: str) -> DataFrame:
    """(label, text) of at most ``rows`` labelled rows outside the held-out fold, the first by a hash of
    the id, then of the text; rows that repeat id and text are one. Only keys, at most ``rows``, are broadcast."""
    chosen = (pick(labels, doc_id="long", **{label: "int"})
              .where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held_out))
              .select(F.col("doc_id").alias("id"), F.col(label).alias("label")).distinct()
              .orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id", "label").limit(rows))
    chosen = scratch(chosen, name + "-ids")
    d = pick(docs, doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    found = scratch(d.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
                     .groupBy("id", "label", F.md5(text.cast("binary")).alias("sha")).agg(F.first(text).alias("text")),
                    name + "-rows")
    keys = ["id", "label", "sha"]                               # an id may stand for many texts
    first = found.select(*keys).orderBy(F.md5(F.col("id").cast("string").cast("binary")), *keys).limit(rows)
    return scratch(found.join(F.broadcast(first), keys, "left_semi").select("label", "text"), name)
