"""Nearest-centroid assignment of unlabelled records and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import vectors as V
from corpusloom.operators import geometry, lengths
from corpusloom.session import checkpoint


def language_means(df: DataFrame, arm: str | None = None) -> DataFrame:
    """L3: mean vector per language over all arms but scope, or over one arm."""
    rows = df.where(F.col("arm") == arm) if arm else df.where("arm <> 'scope'")
    return V.mean_vectors(rows, ["language"])


def centred(df: DataFrame, keep: list[str]) -> DataFrame:
    """L1 with L3: vectors minus their language's pooled mean, renormalised."""
    cols = list(dict.fromkeys([*keep, "language"]))
    return geometry.centre_by(df, "language", language_means(df), cols)


def centroids(rows: DataFrame, level: str = "technique") -> DataFrame:
    """L4: level, n, mean (renormalised) of centred technique-arm vectors."""
    means = V.mean_vectors(rows.where((F.col("arm") == "technique") & F.col(level).isNotNull()), [level])
    return means.withColumn("mean", V.unit("mean"))


def assign(rows: DataFrame, cents: DataFrame, keep: list[str]) -> DataFrame:
    """Keep, best, cos, second_cos, margin."""
    return V.nearest_levels(rows, cents, "technique", "mean", keep)


def confidence(assigned: DataFrame, least_margin: float = 0.02) -> DataFrame:
    """N, mean and least cosine, mean and median margin, margins below the least."""
    assigned = checkpoint(assigned.select("cos", "margin"))
    return assigned.agg(
        F.count("*").alias("n"),
        F.avg("cos").alias("mean_cos"),
        F.min("cos").alias("min_cos"),
        F.avg("margin").alias("mean_margin"),
        F.lit(stats.exact_quantile(assigned, "margin", 0.5)).cast("double").alias("median_margin"),
        F.count_if(F.col("margin") < least_margin).alias("close"),
    )


def crosstab(assigned: DataFrame, row: str = "direction", col: str = "best", marginals: bool = True) -> DataFrame:
    """Long table of counts; marginals have null in the summed column, from one pass of grouping sets."""
    rows = assigned.where(F.col(row).isNotNull())
    if not marginals:
        return rows.groupBy(row, col).agg(F.count("*").alias("n"))
    return rows.cube(row, col).agg(F.count("*").alias("n"))


def association(assigned: DataFrame, row: str = "direction", col: str = "best") -> DataFrame:
    """Chi-squared, degrees of freedom, Cramer's V and p-value of the table."""
    return stats.with_tail(stats.chi_square(crosstab(assigned, row, col, marginals=False), row, col))


#: Cells of a contingency table that the driver may hold.
MAX_CELLS = 1_000_000


def permutation_null(assigned: DataFrame, row: str, col: str, replicates: int = 20_000, seed: int = 0) -> DataFrame:
    """Observed chi2, null mean, null max, hits and p over shuffles of the column labels.

    A shuffle gives a table with the same margins, row by row a draw without
    replacement from the labels that are left, so tables are drawn from the
    margins: a replicate costs rows times columns of the table, not the
    records. Tables above MAX_CELLS cells are refused.
    """
    counted = assigned.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count("*").alias("n"))
    counts = V.level_rows(counted, "r", MAX_CELLS)
    schema = "observed double, null_mean double, null_max double, hits long, p double"
    if not counts:
        return assigned.sparkSession.createDataFrame([], schema)
    r_of = {x: k for k, x in enumerate(sorted({r["r"] for r in counts}))}
    c_of = {x: k for k, x in enumerate(sorted({r["c"] for r in counts}))}
    table = np.zeros((len(r_of), len(c_of)), np.int64)
    for r in counts:
        table[r_of[r["r"]], c_of[r["c"]]] = r["n"]
    rt, ct, n = table.sum(1), table.sum(0), int(table.sum())

    def chi(t: np.ndarray) -> float:
        return float(n * (t * t / np.outer(rt, ct)).sum() - n)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for k in part["id"]:
                rng = np.random.default_rng([seed, int(k)])
                left, t = ct.copy(), np.zeros_like(table)
                for i, m in enumerate(rt[:-1]):
                    t[i] = rng.multivariate_hypergeometric(left, int(m), method="marginals")
                    left -= t[i]
                t[-1] = left
                out.append(chi(t))
            yield pd.DataFrame({"chi2": out})

    observed = chi(table)
    hits = F.count_if(F.round("chi2", 6) >= round(observed, 6))
    null = assigned.sparkSession.range(replicates).mapInPandas(draw, "chi2 double")
    return null.agg(F.lit(observed).alias("observed"), F.avg("chi2").alias("null_mean"), F.max("chi2").alias("null_max"), hits.alias("hits"), ((hits + 1) / (F.count("*") + 1)).alias("p"))


def null_agreement(assigned: DataFrame, row: str, col: str, replicates: int = 20_000, seed: int = 0) -> DataFrame:
    """L8 against what is known of it: the observed chi2, the exact null mean n / (n - 1) (R - 1) (C - 1), and whether the drawn mean agrees.

    The standard error of the drawn mean is about sqrt(2 dof / replicates); five of them are allowed.
    """
    cells = crosstab(assigned, row, col, marginals=False).where(F.col(col).isNotNull())
    dof = (F.count_distinct(row) - 1) * (F.count_distinct(col) - 1)
    exact = cells.agg(dof.alias("dof"), (F.sum("n") / (F.sum("n") - 1) * dof).alias("exact_mean"))
    drawn = permutation_null(assigned, row, col, replicates, seed)
    agrees = F.abs(F.col("null_mean") - F.col("exact_mean")) <= 5 * F.sqrt(2 * F.col("dof") / replicates)
    return drawn.join(F.broadcast(exact)).select("observed", "exact_mean", agrees.alias("agrees"), (F.col("null_max") >= F.col("exact_mean")).alias("max_above_mean"), F.col("p").between(0, 1).alias("p_is_share"))


def length_by_assigned(assigned: DataFrame, z: DataFrame, id_col: str) -> DataFrame:
    """Mean z of log characters per assigned technique."""
    return assigned.join(z.select(id_col, "z"), id_col).where("z is not null").groupBy("best").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))


def mode_by_language(assigned: DataFrame) -> DataFrame:
    """Most frequent assigned technique per direction and language."""
    return lengths.ranked_mode(assigned.where("direction is not null"), ["direction", "language"], "best")


def own_cosines(rows: DataFrame, id_col: str) -> DataFrame:
    """Leave-one-out cosine of technique-arm rows to their own centroid.

    x.(S - x) / |S - x| with the level total S; levels of one row are left out.
    Closed form, so the cost is one pass, not rows times rows.
    """
    arm = rows.where("arm = 'technique' and technique is not null")
    totals = V.sum_vectors(arm, ["technique"]).where("n > 1").select("technique", "total")
    joined = arm.join(totals, "technique")
    xs, xx, ss = V.dot("vec", "total"), V.dot("vec", "vec"), V.dot("total", "total")
    return joined.select(id_col, "technique", ((xs - xx) / F.sqrt(F.greatest(ss - 2 * xs + xx, F.lit(1e-18)))).alias("own_cos"))


def threshold(own: DataFrame, q: float = 0.05) -> DataFrame:
    """One row with the q-quantile, linearly interpolated; null for no rows."""
    return own.sparkSession.createDataFrame([(stats.exact_quantile(own, "own_cos", q),)], "threshold double")


def out_of_set(assigned: DataFrame, limit: DataFrame, by: str = "direction") -> DataFrame:
    """Per direction the rows below the threshold and the mean cosine."""
    rows = assigned.where(F.col(by).isNotNull()).join(F.broadcast(limit))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("cos") < F.col("threshold")).alias("below"), F.avg("cos").alias("mean_cos"))


def scope_test(assigned_scope: DataFrame, limit: DataFrame, top: int = 3) -> DataFrame:
    """Per theorem n, mean cosine, rows below the threshold, leading techniques, mean margin."""
    assigned_scope = checkpoint(assigned_scope.select("theorem", "best", "cos", "margin"))
    base = out_of_set(assigned_scope, limit, "theorem")
    lead = lengths.shares(assigned_scope, "theorem", "best", top)
    text = lead.groupBy("theorem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "best", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ",").alias("leading"))
    margin = assigned_scope.groupBy("theorem").agg(F.avg("margin").alias("mean_margin"))
    return base.join(text, "theorem").join(margin, "theorem")


def centroid_agreement(df: DataFrame, level: str = "technique") -> DataFrame:
    """Centroids of terse and of verbose rows compared.

    One row: n, acc_terse, acc_verbose, agree, terse_on_verbose,
    verbose_on_terse, within, between. `within` is over levels present in both styles,
    `between` over ordered pairs of different terse centroids.
    """
    rows = df.where(F.col(level).isNotNull() & F.col("style").isNotNull())
    means = {s: V.mean_vectors(rows.where(F.col("style") == s), [level]).withColumn("mean", V.unit("mean")) for s in ("terse", "verbose")}
    a = V.nearest_levels(rows, means["terse"], level, "mean", ["line_no", level, "style"]).select("line_no", level, "style", F.col("best").alias("by_terse"))
    b = V.nearest_levels(rows, means["verbose"], level, "mean", ["line_no"]).select("line_no", F.col("best").alias("by_verbose"))
    hit_t, hit_v = (F.col("by_terse") == F.col(level)).cast("double"), (F.col("by_verbose") == F.col(level)).cast("double")
    scores = a.join(b, "line_no").agg(
        F.count("*").alias("n"), F.avg(hit_t).alias("acc_terse"), F.avg(hit_v).alias("acc_verbose"), F.avg((F.col("by_terse") == F.col("by_verbose")).cast("double")).alias("agree"),
        F.avg(F.when(F.col("style") == "verbose", hit_t)).alias("terse_on_verbose"), F.avg(F.when(F.col("style") == "terse", hit_v)).alias("verbose_on_terse"),
    )
    t, v = (means[s].select(F.col(level).alias(f"l_{s}"), F.col("mean").alias(f"m_{s}")) for s in ("terse", "verbose"))
    within = t.join(v, F.col("l_terse") == F.col("l_verbose")).agg(F.avg(V.dot("m_terse", "m_verbose")).alias("within"))
    other = t.select(F.col("l_terse").alias("l2"), F.col("m_terse").alias("m2"))
    between = t.join(V.few(other), F.col("l_terse") != F.col("l2")).agg(F.avg(V.dot("m_terse", "m2")).alias("between"))
    return scores.join(F.broadcast(within)).join(F.broadcast(between))


def agreement_by_cloud(df: DataFrame, level: str = "technique") -> DataFrame:
    """L20 on raw and on leave-one-out centred vectors, told apart by `cloud`."""
    keep = ["line_no", level, "style", "language"]
    clouds = {"raw": df.select(*keep, "vec"), "centred": geometry.centre_leave_one_out(df, "language", keep)}
    parts = [centroid_agreement(checkpoint(rows), level).withColumn("cloud", F.lit(name)) for name, rows in clouds.items()]
    return parts[0].unionByName(parts[1])


def grid_centroid_rank(rows: DataFrame, own_theorem: str) -> DataFrame:
    """Cosine of each scope cell's mean to the grid's mean, and its rank (1: closest)."""
    from pyspark.sql import Window

    grid = V.mean_vectors(rows.where("arm <> 'scope'"), [], "vec", "grid").select("grid")
    cells = V.mean_vectors(rows.where("arm = 'scope'"), ["theorem", "language"])
    cos = V.dot("mean", "grid") / F.greatest(V.norm("mean") * V.norm("grid"), F.lit(1e-9))
    out = cells.join(F.broadcast(grid)).select("theorem", "language", "n", cos.alias("cos"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("cos", 9)), "theorem", "language"))).withColumn("centre", F.col("theorem") == own_theorem)


def opposed_separation(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For opposed directions, the distance of their means over the mean own spread of both."""
    means = V.mean_vectors(rows.where("direction is not null"), ["direction"])
    spread = rows.join(means.select("direction", "mean"), "direction").groupBy("direction").agg(F.avg(V.norm(V.minus("vec", "mean"))).alias("spread"))
    both = means.join(spread, "direction")
    spec = rows.sparkSession.createDataFrame(pairs, "a string, b string")
    a = both.select(F.col("direction").alias("a"), F.col("mean").alias("ma"), F.col("spread").alias("sa"))
    b = both.select(F.col("direction").alias("b"), F.col("mean").alias("mb"), F.col("spread").alias("sb"))
    d = V.norm(V.minus("ma", "mb"))
    return spec.join(a, "a").join(b, "b").select("a", "b", d.alias("distance"), (d / ((F.col("sa") + F.col("sb")) / 2)).alias("separation"))
