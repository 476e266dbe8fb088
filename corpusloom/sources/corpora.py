"""JSON Lines corpora and cached vectors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import cache_name
from corpusloom.schema import RECORD
from corpusloom.session import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one."""
    return f"{shared_root(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """One record per line, blank lines skipped, broken lines as all-null rows, unknown fields ignored.

    Adds `chars` (code points) and `log_chars` (null for empty texts).
    """
    df = spark.read.schema(schema).json(path)
    if "proof" not in df.columns:
        return df
    chars = F.length("proof")
    return df.withColumns({"chars": chars, "log_chars": F.when(chars > 0, F.log(chars.cast("double")))})


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("chars", "log_chars")


def append_jsonl(df: DataFrame, path: str) -> None:
    """S5."""
    _plain(df).write.mode("append").json(path, ignoreNullFields=False)


def append_new(df: DataFrame, path: str) -> None:
    """S5 with J2: only ids that are not stored yet, first of repeated ones."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(RECORD).json(path).select("id").distinct()
    except Exception as e:  # nothing collected yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    fresh = df.dropDuplicates(["id"])
    append_jsonl(fresh if done is None else fresh.join(done, "id", "left_anti").select(*df.columns), path)


def rewrite_jsonl(df: DataFrame, path: str, version: str | None = None) -> str:
    """Writes a new version beside the old one and returns its path; the old one stays as the backup."""
    target = f"{path.rstrip('/')}.v{version or uuid.uuid4().hex}"
    _plain(df).write.mode("errorifexists").json(target, ignoreNullFields=False)
    return target


def write_masked(df: DataFrame, path: str, order: str | None = None) -> str:
    """The masked corpus beside the corpus; kept as it is when it exists."""
    target = path.rstrip("/").removesuffix(".jsonl") + ".masked.jsonl"
    out = _plain(df)
    (out.orderBy(order) if order else out).write.mode("ignore").json(target, ignoreNullFields=False)
    return target


def write_vectors(df: DataFrame, path: str) -> None:
    """Id and vector columns as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def cached(spark: SparkSession, path: str, rows: int, build) -> DataFrame:
    """The cache when it exists with the expected number of rows, else built, written and read."""
    try:
        df = spark.read.parquet(path)
        if df.count() == rows:
            return df
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    write_vectors(build(), path)
    return spark.read.parquet(path)


def align(corpus: DataFrame, vectors: DataFrame, key: str, vec_key: str) -> DataFrame:
    """S3: corpus rows with their vectors by key; fails the job when a corpus row has none."""
    joined = corpus.join(vectors.withColumnRenamed(vec_key, key), key, "left")
    found = F.assert_true(F.col("vec").isNotNull(), F.lit("a record has no vector"))
    return joined.withColumn("vec", F.when(found.isNull(), F.col("vec")))


def cache_path(path: str) -> str:
    """S9 for one path."""
    stem = os.path.splitext(os.path.basename(path))[0].removeprefix("proofs_").replace(".", "_")
    return f"{stem}.vectors.parquet"


__all__ = ["align", "append_jsonl", "append_new", "cache_name", "cache_path", "cached", "read_jsonl", "read_vectors", "rewrite_jsonl", "shared_folder", "write_masked", "write_vectors"]
