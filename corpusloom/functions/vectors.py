"""Dense vectors in array<double> columns.

Means and sums run in the JVM through the ML summarizer, which combines on the
map side; products of many rows with few vectors run as matrix products over
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels a factor may have when its vectors are sent to every worker.
MAX_LEVELS = 5_000
#: Numbers of level vectors sent to every worker at once.
BLOCK_ELEMENTS = 4_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null when an argument is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column | str, by: Column) -> Column:
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, y: x * y)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(a: Column | str, least: float = 1e-9) -> Column:
    """a divided by max(|a|, least); the norm is computed once, not per element."""
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(least)), F.size(a)), lambda x, n: x / n)


def rounded(a: Column | str, places: int = 6) -> Column:
    """Rounded without a negative zero."""
    a = F.col(a) if isinstance(a, str) else a
    return F.round(a, places) + F.lit(0.0)


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec", name: str = "mean") -> DataFrame:
    """keys, n, mean: partial sums on the map side, one small row per level."""
    return _summed(df, keys, vec, vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias(name))


def _summed(df: DataFrame, keys: list[str], vec: str, *aggregates: Column) -> DataFrame:
    """Aggregates of the rows with a vector; without keys one row, with n = 0 and nulls for no rows."""
    rows = df.where(F.col(vec).isNotNull())
    if keys:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), *aggregates)
    # the summarizer has no value for an empty group, so a group of its own stands in for "all"
    found = rows.groupBy(F.lit(1).alias("_all")).agg(F.count("*").alias("n"), *aggregates)
    one = df.sparkSession.range(1).select(F.lit(1).alias("_all"))
    return one.join(found, "_all", "left").drop("_all").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def sum_vectors(df: DataFrame, keys: list[str], vec: str = "vec", name: str = "total") -> DataFrame:
    """keys, n, total vector, squares (sum of squared norms)."""
    return _summed(df, keys, vec, vector_to_array(Summarizer.sum(array_to_vector(F.col(vec)))).alias(name), F.sum(dot(vec, vec)).alias("squares"))


def long_form(df: DataFrame, keys: list[str], vec: str, name: str = "value") -> DataFrame:
    """keys, pos (from 1), rounded value."""
    return df.select(*keys, F.posexplode(vec).alias("pos", name)).select(*keys, (F.col("pos") + 1).cast("int").alias("pos"), rounded(name).alias(name))


def level_rows(df: DataFrame, order: str, most: int = MAX_LEVELS) -> list:
    """The rows of a table of few levels on the driver, in order; refused above `most`."""
    rows = df.orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} levels")
    return rows


def few(df: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    """df marked for broadcast after a check that it has at most `most` rows."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return F.broadcast(df)


def nearest_levels(df: DataFrame, levels: DataFrame, level_col: str, level_vec: str, keep: list[str], vec: str = "vec") -> DataFrame:
    """keep, best, cos, second_cos, margin: the level of highest cosine for every row.

    Level vectors go to the workers in blocks of at most BLOCK_ELEMENTS numbers;
    every block is one more narrow pass with a matrix product per batch, which
    carries the best two so far along. Ties after rounding to nine places go to
    the first level in order. Rows with a null vector are dropped; without
    levels the result is empty; with one level `second_cos` and `margin` are null.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("best", T.StringType()), T.StructField("cos", T.DoubleType()), T.StructField("second_cos", T.DoubleType()), T.StructField(vec, df.schema[vec].dataType)])
    state = df.where(F.col(vec).isNotNull()).select(*keep, F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("cos"), F.lit(None).cast("double").alias("second_cos"), vec)
    names: list[str] = []
    block: list[list[float]] = []
    found = False
    for r in levels.select(level_col, level_vec).where(F.col(level_vec).isNotNull()).orderBy(level_col).toLocalIterator():
        names.append(r[0])
        block.append(r[1])
        if len(block) * len(block[0]) >= BLOCK_ELEMENTS:
            state = state.mapInArrow(_nearer(names, block, len(keep), schema.names), schema)
            names, block, found = [], [], True
    if block:
        state = state.mapInArrow(_nearer(names, block, len(keep), schema.names), schema)
    elif not found:
        state = state.limit(0)
    return state.select(*keep, "best", "cos", "second_cos", (F.col("cos") - F.col("second_cos")).alias("margin"))


def _nearer(names: list[str], block: list[list[float]], kept: int, out: list[str]):
    matrix = np.asarray(block, float)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(kept + 3)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cos = np.round(x @ matrix.T, 9)
            ix = np.arange(len(cos))
            k = cos.argmax(axis=1)
            top = cos[ix, k]
            next_best = np.partition(cos, -2, axis=1)[:, -2] if len(names) > 1 else np.full(len(cos), -np.inf)
            was = batch.column(kept + 1).to_numpy(zero_copy_only=False).astype(float)
            was2 = batch.column(kept + 2).to_numpy(zero_copy_only=False).astype(float)
            was, was2 = np.where(np.isnan(was), -np.inf, was), np.where(np.isnan(was2), -np.inf, was2)
            new = top > was  # earlier blocks hold earlier names, so they keep ties
            best = [names[j] if n else b for j, n, b in zip(k.tolist(), new.tolist(), batch.column(kept).to_pylist())]
            first = np.maximum(top, was)
            second = np.maximum(np.minimum(top, was), np.maximum(next_best, was2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(best, pa.string()), pa.array(first), pa.array(second, mask=np.isneginf(second)), column], names=out)

    return run
