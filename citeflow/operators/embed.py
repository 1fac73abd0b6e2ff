"""Text encoders behind one protocol.

``Embedder.transform(df, id_col, text_col) -> (id, vec array<double>)``.

* :class:`HashingEmbedder` (default, no model weights needed): signed feature
  hashing of the vectorizer tokens into ``dim`` slots, L2-normalised. Tokens are
  made by JVM expressions; the rows stay where they are (no shuffle), an Arrow
  batch at a time is hashed once per distinct token and added up. Rows are
  encoded one by one, also where they share an id.
* :class:`StructuredEmbedder`: the same over the fields of a paper (title,
  abstract, concepts, venue, authors, affiliations). A token counts as a feature
  of its field and as one of its field and position (the place of the author,
  affiliation or concept, the window of a text), so equal words in other fields
  and places move the vector differently.
* :class:`PandasEmbedder`: base for neural plug-ins. ``load()`` runs once per
  partition inside ``mapInPandas`` (never once per row, never shipped with
  every task) and ``encode(texts) -> ndarray`` works on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import ship_package

FEATURES_AT_ONCE = 200_000


class Embedder:
    dim: int

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        raise NotImplementedError


class HashingEmbedder(Embedder):
    def __init__(self, dim: int = 64, seed: int = 42):
        self.dim = dim
        self.seed = seed

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        words = F.coalesce(tokens(text_col), F.array().cast("array<string>"))
        return self.encode(df.select(id_col, words.alias("features"), F.array_repeat(F.lit(1.0), F.size(words)).alias("weights")))

    def encode(self, rows: DataFrame) -> DataFrame:
        """(id, vec) of rows (id, features array<string>, weights array<double>); without features the zero vector."""
        ship_package(rows.sparkSession)
        dim, seed, id_field = self.dim, self.seed, rows.schema.fields[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in feature_slices(b):
                    lists = part.column(1)
                    row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                    coded = lists.flatten().dictionary_encode()
                    slot, sign = hashed_features(coded.dictionary.to_pylist(), dim, seed)
                    code = coded.indices.to_numpy()
                    out = np.zeros((part.num_rows, dim))
                    np.add.at(out, (row, slot[code]), sign[code] * part.column(2).flatten().to_numpy())
                    size = np.linalg.norm(out, axis=1, keepdims=True)
                    out /= np.where(size > 0, size, 1.0)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column(0), vec], names=[id_field.name, "vec"])
        return rows.mapInArrow(run, StructType([id_field, StructField("vec", ArrayType(DoubleType()))]))


def feature_slices(batch: pa.RecordBatch, limit: int = FEATURES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about ``limit`` features each (one row at least)."""
    upto = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def hashed_features(features: list[str], dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each feature, from the md5 of ``seed:feature`` (which SQL engines have, too)."""
    digests = [hashlib.md5(f"{seed}:{f}".encode()).hexdigest() for f in features]
    return (np.array([int(d[:8], 16) % dim for d in digests], np.int64),
            np.array([1.0 if d[8] < "8" else -1.0 for d in digests]))


# name of a field -> whether it is a list (a position is a place in it) or a text (a window of WINDOW tokens)
PAPER_FIELDS = {"title": False, "abstract": False, "concepts": True, "venue": False, "authors": True, "affiliations": True}
WINDOW = 64
PLACED = 0.5            # weight of a token at its position, beside 1 for the token in its field


class StructuredEmbedder(HashingEmbedder):
    """``caps`` bounds the tokens that a field contributes (none by default: whole texts)."""

    def __init__(self, dim: int = 64, seed: int = 42, caps: dict[str, int] | None = None):
        super().__init__(dim, seed)
        self.caps = caps or {}

    def transform_papers(self, papers: DataFrame, id_col: str) -> DataFrame:
        """(id, vec) of papers with the columns of PAPER_FIELDS; a missing or null field adds nothing."""
        features, weights = [], []
        for name, is_list in PAPER_FIELDS.items():
            if name not in papers.columns:
                continue
            own = self._list(name) if is_list else self._text(name)
            if name in self.caps:
                own = F.slice(own, 1, self.caps[name])
            own = F.coalesce(own, F.array().cast("array<struct<tok:string,pos:int>>"))
            features += self._features(name, own)
            weights += [F.array_repeat(F.lit(1.0), F.size(own)), F.array_repeat(F.lit(PLACED), F.size(own))]
        none = F.array().cast("array<string>"), F.array().cast("array<double>")
        return self.encode(papers.select(id_col, F.concat(*features, none[0]).alias("features"), F.concat(*weights, none[1]).alias("weights")))

    @staticmethod
    def _features(name: str, own) -> list:
        return [F.transform(own, lambda x: F.concat(F.lit(name + ":"), x["tok"])),
                F.transform(own, lambda x: F.concat(F.lit(name + "#"), x["pos"].cast("string"), F.lit(":"), x["tok"]))]

    @staticmethod
    def _text(name: str):
        return F.transform(tokens(name), lambda t, i: F.struct(t.alias("tok"), F.floor(i / WINDOW).cast("int").alias("pos")))

    @staticmethod
    def _list(name: str):
        place = lambda x, i: F.transform(tokens(F.coalesce(x, F.lit(""))), lambda t: F.struct(t.alias("tok"), i.alias("pos")))
        return F.flatten(F.transform(F.col(name), place))


class PandasEmbedder(Embedder):
    """Base for model plug-ins; subclasses define ``load`` and ``encode``."""

    dim: int = 0

    def load(self):  # pragma: no cover - plug-in hook
        return None

    def encode(self, model, texts: pd.Series) -> np.ndarray:  # pragma: no cover
        raise NotImplementedError

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        ship_package(df.sparkSession)
        id_type = df.schema[id_col].dataType.simpleString()
        plugin = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = plugin.load()           # once per partition
            for b in batches:
                texts = b[text_col].fillna("")
                m = np.asarray(plugin.encode(model, texts), dtype=np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                n[n == 0] = 1.0
                yield pd.DataFrame({id_col: b[id_col].values, "vec": list(m / n)})

        return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, vec array<double>")


class RandomProjectionEmbedder(PandasEmbedder):
    """Example plug-in: a seeded projection of hashed character trigrams (numpy only)."""

    def __init__(self, dim: int = 32, buckets: int = 4096, seed: int = 7):
        self.dim, self.buckets, self.seed = dim, buckets, seed

    def load(self):
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((self.buckets, self.dim))

    def encode(self, model, texts: pd.Series) -> np.ndarray:
        import zlib
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            t = t.lower()
            idx = [zlib.crc32(t[j:j + 3].encode()) % self.buckets for j in range(max(len(t) - 2, 0))]
            if idx:
                out[i] = model[np.asarray(idx)].sum(axis=0)
        return out


