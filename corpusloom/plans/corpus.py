"""Views of the driver tables as the corpus the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("en", "fr", "de", "es", "zh", "ja")
DENSE_SCRIPTS = ("zh", "ja")
OWN_THEOREM = "primes_unbounded"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(c: str) -> Column:
    return F.lower(F.trim(c))


def known(c: str, levels: tuple[str, ...]) -> Column:
    """The trimmed lower-case label if it is one of the levels, else null."""
    return F.when(plain(c).isin(*levels), plain(c))


def corpus(spark: SparkSession, sf_dir: str, name: str = "proofs_primes") -> DataFrame:
    """The proof corpus with labels brought to their plain form.

    Labels that are null, misspelt or written otherwise become null ('und' for
    the language); `chars` counts code points, `log_chars` is null for empty
    texts instead of failing.
    """
    raw = table(spark, sf_dir, name)
    codes = table(spark, sf_dir, "techniques").select(F.col("technique").alias("code")).distinct()
    chars = F.length("proof")
    return (
        raw.join(codes, plain("technique") == F.col("code"), "left")
        .select(
            "line_no", "id", "arm", "theorem",
            F.col("code").alias("technique"),
            F.nullif(plain("direction"), F.lit("")).alias("direction"),
            F.coalesce(known("language", LANGUAGES), F.lit("und")).alias("language"),
            known("style", ("terse", "verbose")).alias("style"),
            "sample_index", "model", "effort", "max_tokens", "prompt", "proof", "stop_reason", "usage", "batch_id", "collected_at",
            chars.alias("chars"),
            F.when(chars > 0, F.log(chars.cast("double"))).alias("log_chars"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows that have an embedding; `technique` is the code's first part, `vec` double.

    The join is on the key, never on position.
    """
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_no"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    rows = corpus(spark, sf_dir).select("line_no", "arm", "theorem", F.split_part("technique", F.lit("_"), F.lit(1)).alias("technique"), "direction", "language", "style", "log_chars", "proof")
    return rows.join(emb, "line_no")
