"""Statistics over count tables, as aggregations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpoint


def chi_square(counts: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """One row: total, rows, cols, chi2, dof, cramers_v of a long count table.

    Null rows or columns are left out. With fewer than two rows or columns V is
    null. Uses n * sum(O^2 / (R C)) - n, one pass over the cells and its margins.
    """
    cells = counts.where(F.col(row).isNotNull() & F.col(col).isNotNull() & (F.col(n) > 0)).select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(n).cast("double").alias("o"))
    by_row = cells.groupBy("r").agg(F.sum("o").alias("rt"))
    by_col = cells.groupBy("c").agg(F.sum("o").alias("ct"))
    joined = cells.join(by_row, "r").join(by_col, "c")
    out = joined.agg(
        F.coalesce(F.sum("o"), F.lit(0.0)).cast("long").alias("total"),
        F.count_distinct("r").alias("rows"),
        F.count_distinct("c").alias("cols"),
        F.sum(F.col("o") * F.col("o") / (F.col("rt") * F.col("ct"))).alias("s"),
    )
    chi = F.col("total") * F.col("s") - F.col("total")
    least = F.least("rows", "cols") - 1
    return out.select(
        "total",
        "rows",
        "cols",
        chi.alias("chi2"),
        ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"),
        F.when(least > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("total") * least))).alias("cramers_v"),
    )


def chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution, from its finite series.

    For even dof the tail is e^-h * sum h^i / i! over i < dof / 2 with h = x / 2;
    for odd dof half-integer terms follow erfc(sqrt(h)). All terms are positive,
    so small tails keep their digits.
    """
    if dof < 1:
        return 1.0
    h = max(x, 0.0) / 2
    first = 0.5 if dof % 2 else 0.0
    steps = np.arange(dof // 2) + first
    if h == 0:
        return 1.0
    logs = steps * math.log(h) - h - np.array([math.lgamma(t + 1) for t in steps])
    return min(1.0, float(np.exp(logs).sum()) + (math.erfc(math.sqrt(h)) if dof % 2 else 0.0))


def with_tail(table: DataFrame) -> DataFrame:
    """chi_square's row with `p`; null where there are no degrees of freedom."""
    tail = F.pandas_udf(lambda x, d: x.combine(d, lambda a, b: chi_square_tail(float(a), int(b)) if a == a and b > 0 else None).astype("float64"), "double")
    return table.withColumn("p", tail(F.col("chi2").cast("double"), F.col("dof").cast("long")))


def mutual_information(counts: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """One row: mi, h_row, h_col, nmi (mutual information over the mean entropy; 1 when both are constant)."""
    cells = counts.where(F.col(row).isNotNull() & F.col(col).isNotNull() & (F.col(n) > 0)).select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(n).cast("double").alias("o"))
    total = cells.agg(F.sum("o").alias("t"))
    by_row = cells.groupBy("r").agg(F.sum("o").alias("rt"))
    by_col = cells.groupBy("c").agg(F.sum("o").alias("ct"))
    mi = cells.join(by_row, "r").join(by_col, "c").join(F.broadcast(total)).agg(F.sum(F.col("o") / F.col("t") * F.log(F.col("o") * F.col("t") / (F.col("rt") * F.col("ct")))).alias("mi"))
    hr = by_row.join(F.broadcast(total)).agg((-F.sum(F.col("rt") / F.col("t") * F.log(F.col("rt") / F.col("t")))).alias("h_row"))
    hc = by_col.join(F.broadcast(total)).agg((-F.sum(F.col("ct") / F.col("t") * F.log(F.col("ct") / F.col("t")))).alias("h_col"))
    both = mi.join(F.broadcast(hr)).join(F.broadcast(hc))
    mean = (F.col("h_row") + F.col("h_col")) / 2
    return both.select("mi", "h_row", "h_col", F.when(mean > 1e-12, F.col("mi") / mean).otherwise(F.lit(1.0)).alias("nmi"))


def exact_quantile(df: DataFrame, col: str, q: float, bins: int = 4096, small: int = 50_000) -> float | None:
    """The q-quantile with linear interpolation, exact, without holding all values in one task.

    The column is written once, so that every pass sees the same values. Histograms
    of `bins` equal ranges narrow the interval of the two ranks
    needed until at most `small` values are left in it; those are sorted.
    None for no values.
    """
    rows = checkpoint(df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = q * (n - 1)
    first = int(at)
    need = (first, min(first + 1, n - 1))
    before, inside = 0, n
    while inside > small and high > low:
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            break
        b = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        part = rows.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        seen, kept = before, []
        for r in part:
            if seen <= need[1] and seen + r["n"] > need[0]:
                kept.append((seen, r))
            seen += r["n"]
        new = sum(r["n"] for _, r in kept)
        if new == inside:
            break
        before, inside = kept[0][0], new
        low, high = kept[0][1]["lo"], kept[-1][1]["hi"]
    if high <= low:
        return float(low)
    # distinct values with their counts: repeated values take no room
    left = rows.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
    found, seen = {}, before
    for r in left:
        for k in need:
            if seen <= k < seen + r["n"]:
                found[k] = r["v"]
        seen += r["n"]
    return float(found[need[0]] + (at - first) * (found[need[1]] - found[need[0]]))
