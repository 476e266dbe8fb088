"""Text embedding with an injected encoder, and a two-dimensional view."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embed(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str, text_col: str = "proof", batch: int = 8) -> DataFrame:
    """Id, vec (unit length). `load` runs once per worker and gives a function texts -> rows.

    Null texts are encoded as empty ones.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                x = np.asarray(encode(texts[at : at + batch]), float)
                out += (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def hashed_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in for tests: signed hashed character trigrams."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import xxhash

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for k in range(max(1, len(t) - 2)):
                    h = xxhash.xxh3_64_intdigest(t[k : k + 3])
                    out[i, h % dim] += 1 if h >> 32 & 1 else -1
            return out

        return encode

    return load


def flat_view(df: DataFrame, id_col: str, vec: str = "vec") -> DataFrame:
    """L40's place: id, x, y on the two leading principal components (for looking, never for scoring)."""
    rows = df.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(F.col(vec)).alias("features"))
    low = PCA(k=2, inputCol="features", outputCol="low").fit(rows).transform(rows).select(id_col, vector_to_array("low").alias("low"))
    return low.select(id_col, F.col("low")[0].alias("x"), F.col("low")[1].alias("y"))
