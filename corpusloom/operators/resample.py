"""Deterministic resampling: permutations, picks and bootstrap draws by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V


def draw_key(seed: int, *parts: Column | str) -> Column:
    """md5 of the seed and the parts: the same order in every engine."""
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def place_within(df: DataFrame, keys: list[str], order: list[Column], part: Column, name: str = "place") -> DataFrame:
    """df with the row's place (from 0) within keys by `order`, never sorting a whole group in one task.

    `part` must not fall along `order`. Rows are ranked within (keys, part) and
    shifted by the rows of the earlier parts, which come from pre-aggregated
    counts; null keys are keys like others.
    """
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    shift = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    shifts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), shift.alias("_shift"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(shifts, same).withColumn(name, (F.col("_local") + F.col("_shift")).cast("long"))
    return out.drop("_part", "_local", "_p", "_shift", *[f"_k{i}" for i in range(len(keys))])


def number_part(c: str, width: int = 100_000) -> Column:
    """Parts of a whole-number order column."""
    return F.floor(F.col(c) / width)


def one_per_cell(df: DataFrame, cell: list[str], id_col: str, seed: int = 0) -> DataFrame:
    """The row of each cell with the smallest draw key: a partial minimum, no sort of cells."""
    key = F.struct(draw_key(seed, id_col).alias("k"), F.col(id_col))
    return df.groupBy(*cell).agg(F.min_by(id_col, key).alias(id_col))


def shuffled_labels(df: DataFrame, id_col: str, label: str, cell: list[str], replicates: int = 1, seed: int = 0) -> DataFrame:
    """Replicate, id, label, shuffled: labels permuted within the cell, once per replicate.

    Two places, by id and by draw key, are matched within (replicate, cell).
    """
    spark = df.sparkSession
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    # every replicate holds every record by definition
    rows = df.select(id_col, label, *[c for c in cell if c not in (id_col, label)]).crossJoin(F.broadcast(reps))
    rows = rows.withColumn("_key", draw_key(seed, "replicate", id_col))
    groups = ["replicate", *cell]
    placed = place_within(rows, groups, [F.col(id_col)], number_part(id_col))
    placed = place_within(placed, groups, [F.col("_key"), F.col(id_col)], F.substring("_key", 1, 2), "drawn")
    keys = ["replicate", *cell]
    source = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("drawn").alias("_place"), F.col(label).alias("shuffled"))
    same = F.col("place") == F.col("_place")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(source, same).select("replicate", id_col, label, "shuffled")


def folds(df: DataFrame, label: str, order: str, k: int = 5) -> DataFrame:
    """Unshuffled stratified folds: each class is cut in order into k parts of almost equal size.

    The class size and a row's place decide. `order` is a whole number.
    """
    placed = place_within(df, [label], [F.col(order)], number_part(order), "_at")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    q, r = F.floor(F.col("_size") / k), F.col("_size") % k
    head = r * (q + 1)
    fold = F.when(F.col("_at") < head, F.floor(F.col("_at") / (q + 1))).otherwise(r + F.floor((F.col("_at") - head) / F.greatest(q, F.lit(1))))
    return placed.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn("fold", fold.cast("int")).drop("_at", "_label", "_size")


# --------------------------------------------------------------------------
# many replicates in one pass: records are read once, each with its weights

#: Numbers of one block of records times replicates.
BLOCK_ELEMENTS = 4_000_000
# The chances of 0, 1, 2, ... draws of one record, summed up.
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def mixed(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each key (rows) and salt (columns)."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + salts.astype(np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(by)
        return h ^ (h >> np.uint64(31))


def shuffled_places(places: np.ndarray, sizes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Place p of a cell of n records -> its place in the shuffle of each salt: a bijection of 0..n-1.

    A keyed network on the next even power of two, walked until it falls below
    n, so no task needs the other records of the cell.
    """
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64) // 2)).astype(np.uint64)[:, None]
    low = (np.uint64(1) << half) - np.uint64(1)
    n = sizes.astype(np.uint64)[:, None]
    out = np.broadcast_to(places.astype(np.uint64)[:, None], (len(places), len(salts))).copy()
    open_ = np.ones(out.shape, bool)
    keys = mixed(np.zeros(1, np.int64), salts)
    with np.errstate(over="ignore"):
        while open_.any():
            a, b = out >> half, out & low
            for turn in range(12):  # small cells need many turns until no place is favoured
                f = (b + keys + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(32)
                a, b = b, a ^ (f & low)
            out = np.where(open_, (a << half) | b, out)
            open_ &= out >= n
    return out.astype(np.int64)


def _replicate_sums(df: DataFrame, weigh: Callable, groups: list[str], replicates: int, seed: int) -> DataFrame:
    """replicate, group, n, mean over weighted vectors; `df` holds vec last, before it what `weigh` needs.

    `weigh(columns, salts)` yields (group number, weights of records x salts).
    A task adds up one matrix product per batch and group, and sends one row per
    replicate and group it has met.
    """
    salts = np.random.default_rng(seed).integers(1, 1 << 62, replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            rows = max(1, BLOCK_ELEMENTS // replicates)
            for at in range(0, len(x), rows):
                part = slice(at, at + rows)
                for g, w in weigh([c[part] for c in columns], salts):
                    if g not in total:
                        total[g], count[g] = np.zeros((replicates, x.shape[1])), np.zeros(replicates)
                    total[g] += w.T @ x[part]
                    count[g] += w.sum(0)
        for g in sorted(total):
            met = np.flatnonzero(count[g] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(met.astype(np.int32)), pa.array([groups[g]] * len(met), pa.string()), pa.array(count[g][met]), pa.array(list(total[g][met]), pa.list_(pa.float64()))], names=["replicate", "grp", "weight", "total"]
            )

    sums = df.mapInArrow(run, "replicate int, grp string, weight double, total array<double>")
    whole = V.sum_vectors(sums.withColumn("vec", F.concat(F.array("weight"), "total")), ["replicate", "grp"]).select("replicate", "grp", F.element_at("total", 1).alias("weight"), F.expr("slice(total, 2, size(total) - 1)").alias("total"))
    return whole.select("replicate", "grp", "weight", V.scale("total", 1.0 / F.col("weight")).alias("mean"))


#: Cells up to this size are drawn exactly; in larger ones the chance of drawing nothing is below e^-64.
SMALL_CELL = 64


def bootstrap_means(df: DataFrame, cell: str, id_col: str, replicates: int, seed: int = 0, vec: str = "vec") -> DataFrame:
    """Replicate, cell, weight, mean: cell means under resampling with replacement.

    A record is drawn a Poisson number of times with mean one, from its id and
    the replicate, independent of the partitioning. A cell of at most SMALL_CELL
    records makes as many draws as it has records, so that it is never empty.
    """
    rows = df.where(F.col(cell).isNotNull() & F.col(vec).isNotNull())
    levels = V.level_rows(rows.groupBy(cell).agg(F.count("*").alias("n")), cell)
    if not levels:
        return df.sparkSession.createDataFrame([], f"replicate int, {cell} string, weight double, mean array<double>")
    cells, sizes = [r[cell] for r in levels], np.array([r["n"] for r in levels])
    code = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(cells) for x in (c, k)]), F.col(cell))
    rows = rows.select(F.xxhash64(id_col).alias("key"), code.alias("code"), vec)
    small = [k for k, n in enumerate(sizes.tolist()) if n <= SMALL_CELL]
    place = F.row_number().over(Window.partitionBy("code").orderBy("key")) - 1
    rows = rows.where(~F.col("code").isin(small)).select("key", "code", F.lit(-1).alias("place"), vec).unionByName(rows.where(F.col("code").isin(small)).select("key", "code", place.alias("place"), vec))

    def weigh(columns: list[np.ndarray], salts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        key, codes, places = columns
        for g in np.unique(codes).tolist():
            own = codes == g
            out = np.zeros((len(codes), len(salts)))
            n = int(sizes[g])
            slots = np.arange(n) + (g + 1) * (SMALL_CELL + 1) if n <= SMALL_CELL else key[own]
            u = (mixed(slots, salts) >> np.uint64(11)).astype(float) / float(1 << 53)
            if n <= SMALL_CELL:
                drawn = np.minimum((u * n).astype(np.int64), n - 1)
                out[own] = (drawn[None, :, :] == places[own][:, None, None]).sum(1)
            else:
                out[own] = np.searchsorted(_POISSON, u, side="right")
            yield g, out

    return _replicate_sums(rows, weigh, cells, replicates, seed).withColumnRenamed("grp", cell)


def shuffled_means(df: DataFrame, label: str, cell: list[str], id_col: str, replicates: int, seed: int = 0, vec: str = "vec") -> DataFrame:
    """Replicate, label, weight, mean: label means after the labels are shuffled within the cells.

    A record's place in its cell is found once; a replicate's shuffle of places
    is a keyed bijection, and the cell's label counts tell which label the new
    place has, so labels keep their numbers in every cell exactly and no record
    is copied.
    """
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*cell, label).agg(F.count("*").alias("n"))
    spec = V.level_rows(counts.select(F.to_json(F.struct(*cell), {"ignoreNullFields": "false"}).alias("cell"), F.col(label).alias("label"), "n"), "cell", 100_000)
    if not spec:
        return df.sparkSession.createDataFrame([], f"replicate int, {label} string, weight double, mean array<double>")
    cells, labels = sorted({r["cell"] for r in spec}), sorted({r["label"] for r in spec})
    table = np.zeros((len(cells), len(labels)), np.int64)
    for r in spec:
        table[cells.index(r["cell"]), labels.index(r["label"])] = r["n"]
    upto, size = table.cumsum(1), table.sum(1)
    codes = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(cells)], "cell_ string, code int")
    placed = place_within(rows.select(id_col, *cell, vec), cell, [F.col(id_col)], number_part(id_col))
    placed = placed.withColumn("cell_", F.to_json(F.struct(*cell), {"ignoreNullFields": "false"})).join(V.few(codes, 100_000), "cell_").select("place", "code", vec)

    def weigh(columns: list[np.ndarray], salts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        place, code = columns
        at = shuffled_places(place, size[code], salts)
        new = np.zeros(at.shape, np.int64)
        for c in np.unique(code).tolist():
            own = code == c
            new[own] = np.searchsorted(upto[c], at[own], side="right")
        for g in range(len(labels)):
            yield g, (new == g).astype(float)

    return _replicate_sums(placed, weigh, labels, replicates, seed).withColumnRenamed("grp", label)
