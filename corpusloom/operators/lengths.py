"""Integrity and length statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.resample import number_part, place_within


def arm_counts(df: DataFrame) -> DataFrame:
    """Rows per arm."""
    return df.groupBy("arm").agg(F.count("*").alias("n"))


def integrity(df: DataFrame) -> DataFrame:
    """Rows, distinct ids, truncated by stop reason, empty texts (null counts as empty)."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.col("stop_reason") == "max_tokens").alias("truncated"),
        F.count_if(F.coalesce(F.length("proof"), F.lit(0)) == 0).alias("empty"),
    )


def value_sets(df: DataFrame, fields: list[str]) -> DataFrame:
    """A3: field, levels (sorted, joined), several; sets are of distinct values only."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.field", "x.value").where("value is not null").distinct()
    return long.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("levels"), (F.count("*") > 1).alias("several"))


def mixed_cells(df: DataFrame, keys: list[str], field: str = "prompt") -> DataFrame:
    """A4: cells with more than one distinct prompt."""
    return df.groupBy(*keys).agg(F.count_distinct(field).alias("prompts")).where("prompts <> 1")


def cell_spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """A5: n, median characters, sample sd over mean (null for one row or a zero mean).

    Rows are counted per length first, so a cell costs its distinct lengths.
    """
    lengths = df.where("chars is not null").groupBy(*keys, "chars").agg(F.count("*").alias("_rows"))
    n, total = F.sum("_rows"), F.sum(F.col("_rows") * F.col("chars")).cast("double")
    mean = total / n
    # whole numbers, so the squares are added up without loss
    spread = (F.sum(F.col("_rows") * F.col("chars") * F.col("chars")).cast("double") - total * total / n) / F.nullif(n - 1, F.lit(0))
    return lengths.groupBy(*keys).agg(n.alias("n"), F.percentile("chars", F.lit(0.5), F.col("_rows")).alias("median_chars"), F.when((mean > 0) & (n > 1), F.sqrt(F.greatest(spread, F.lit(0.0))) / mean).alias("cv"))


def language_baseline(df: DataFrame) -> DataFrame:
    """Mean and sample sd of log characters per language, scope arm left out."""
    return df.where("arm <> 'scope'").groupBy("language").agg(F.count("log_chars").alias("n"), F.avg("log_chars").alias("mean_log"), F.stddev_samp("log_chars").alias("sd_log"))


def z_scores(df: DataFrame, estimate_on: Column, spread: str = "samp", zero_to_one: bool = False, name: str = "z") -> DataFrame:
    """W1 (samp), W2 (pop), W3 (pop, zero sd as 1): log characters normalised within the language.

    The baseline is an aggregate of few levels joined back, so a language that
    holds most rows is not pulled into one task as a window would. Languages
    without a baseline give null.
    """
    sd = (F.stddev_samp if spread == "samp" else F.stddev_pop)("log_chars")
    base = df.where(estimate_on).groupBy("language").agg(F.avg("log_chars").alias("_m"), sd.alias("_s"))
    s = F.coalesce(F.nullif(F.col("_s"), F.lit(0.0)), F.lit(1.0)) if zero_to_one else F.nullif(F.col("_s"), F.lit(0.0))
    return df.join(base, "language", "left").withColumn(name, (F.col("log_chars") - F.col("_m")) / s).drop("_m", "_s")


def cell_means(df: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """Mean per cell."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean_z"))


def mean_of_means(cells: DataFrame, key: str, value: str = "mean_z") -> DataFrame:
    """Unweighted mean of the cell means."""
    return cells.groupBy(key).agg(F.count("*").alias("cells"), F.avg(value).alias("mean_z"))


def script_gap(df: DataFrame, dense: tuple[str, ...], threshold: float = 0.25) -> DataFrame:
    """Mean z of dense and other scripts per direction, their gap and its flag."""
    is_dense = F.col("language").isin(*dense)
    out = df.groupBy("direction").agg(F.avg(F.when(is_dense, F.col("z"))).alias("dense"), F.avg(F.when(~is_dense, F.col("z"))).alias("other"))
    return out.withColumn("gap", F.col("dense") - F.col("other")).withColumn("flagged", F.abs("gap") > threshold)


def centre_difference(df: DataFrame, directions: DataFrame, own_theorem: str) -> DataFrame:
    """A10: direction mean minus the mean z of the scope arm's own theorem (one row, joined to all)."""
    centre = df.where((F.col("arm") == "scope") & (F.col("theorem") == own_theorem)).agg(F.avg("z").alias("centre"))
    return directions.join(F.broadcast(centre)).withColumn("difference", F.col("mean_z") - F.col("centre"))


def range_over_spread(cells: DataFrame) -> DataFrame:
    """Range of direction means over the mean within-direction sd of the cell means."""
    per = cells.groupBy("direction").agg(F.avg("mean_z").alias("m"), F.stddev_samp("mean_z").alias("s"))
    return per.agg((F.max("m") - F.min("m")).alias("between"), F.avg("s").alias("within")).withColumn("ratio", F.col("between") / F.nullif(F.col("within"), F.lit(0.0)))


def retained_length(df: DataFrame, masked: str, placeholder: str, keys: list[str]) -> DataFrame:
    """Share of the text kept under masking, overall or by keys."""
    kept = F.sum(F.length(F.replace(F.col(masked), F.lit(placeholder), F.lit("")))) / F.sum(F.length("proof"))
    return df.where("proof is not null").groupBy(*keys).agg(F.count("*").alias("n"), kept.alias("kept"))


def ranked_mode(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Most frequent level per group, ties to the first by name; groups without levels are left out."""
    counts = df.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(level).alias("lvl")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.lvl").alias(level), (-F.col("b.neg")).alias("n"))


def shares(df: DataFrame, key: str, level: str, top: int | None = None) -> DataFrame:
    """Count, share and rank of levels within key; the window runs over pre-aggregated levels."""
    counts = df.where(F.col(level).isNotNull()).groupBy(key, level).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("n"), level)))
    return out if top is None else out.where(F.col("place") <= top)


def sample_index(df: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Running number within the cell, from 0, by a whole-number order column."""
    return place_within(df, cell, [F.col(order)], number_part(order), "k")


def level_codes(df: DataFrame, level: str) -> DataFrame:
    """Level, code: place in sorted order from 0. Only the distinct levels are ordered."""
    levels = df.where(F.col(level).isNotNull()).select(level).distinct()
    return levels.withColumn("code", F.row_number().over(Window.orderBy(level)) - 1)
