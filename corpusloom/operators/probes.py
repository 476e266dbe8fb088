"""Linear probes and clusterings.

A probe minimises mean log loss plus half the squared weights over n, the
intercept free. Probes on dense vectors are trained side by side: every round
is one pass over the records that adds up loss and gradient of all probes at
their own trial points, so a grid of folds, labels and dimensions costs the
rounds of its slowest probe. Probes on words use Spark ML's sparse vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import stats
from corpusloom.functions import vectors as V
from corpusloom.operators import lexical, resample

#: Rows that are worth a task of their own in every round.
ROWS_PER_TASK = 5_000
#: Fits of word probes that run side by side.
PARALLEL_FITS = 8
#: Partial sums that the driver adds up itself; more are added up by the executors first.
FEW_PARTS = 8
#: Rounds after which a probe stops.
MAX_ITER = 3_000
#: Distinct terms that a word probe may weigh.
MAX_VOCABULARY = 1 << 20


def _side_by_side(jobs: list[Callable]) -> list:
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def _frame(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def levels_of(df: DataFrame, label: str, most: int = 1000) -> list[str]:
    """Sorted levels of a label; refused above `most`."""
    return [r[0] for r in V.level_rows(df.where(F.col(label).isNotNull()).select(label).distinct(), label, most)]


def _code(label: str, levels: list[str]) -> Column:
    """The level's number, -1 for null."""
    if not levels:
        return F.lit(-1)
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in enumerate(levels) for x in (F.lit(v), F.lit(k))]), F.col(label)), F.lit(-1))


# --------------------------------------------------------------------------
# probes on dense vectors, trained side by side


@dataclass
class Probe:
    """One probe: the label column it tells, the leading dimensions it sees, and its training and test rows.

    `train` and `test` are (column, value, equal): rows where the column has
    the value, or has another one.
    """

    label: str
    classes: int
    train: tuple[str, int, bool]
    test: tuple[str, int, bool]
    dims: int | None = None
    weights: np.ndarray | None = None
    past: list = field(default_factory=list)
    value: float = np.inf
    slope: np.ndarray | None = None
    trial: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    rows: int = 0
    done: bool = False


def _picked(tags: dict[str, np.ndarray], label: str, rule: tuple[str, int, bool]) -> np.ndarray:
    column, value, equal = rule
    at = tags[column]
    return (tags[label] >= 0) & (at >= 0) & ((at == value) if equal else (at != value))


def _scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:, :-1].T + w[:, -1]


def _batch(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, {n: batch.column(k + 1).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}


def _evaluate(rows: DataFrame, names: list[str], asked: list[tuple[int, Probe]], pieces: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """Rows, summed log loss and gradient of each asked probe at its trial point, from one pass."""
    points = [(k, p.label, p.train, p.dims, p.trial) for k, p in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, tags = _batch(batch, names)
            for k, label, train, dims, w in points:
                own = _picked(tags, label, train)
                if not own.any():
                    continue
                xs, y = x[own][:, :dims], tags[label][own]
                z = _scores(xs, w)
                z -= z.max(1, keepdims=True)
                e = np.exp(z)
                total = e.sum(1)
                at = np.arange(len(y))
                loss = float((np.log(total) - z[at, y]).sum())
                e /= total[:, None]
                e[at, y] -= 1
                grad = np.concatenate([e.T @ xs, e.sum(0)[:, None]], axis=1).ravel()
                part = np.concatenate([[len(y), loss], grad])
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["probe", "vec"])

    parts = rows.mapInArrow(run, "probe int, vec array<double>")
    if pieces > FEW_PARTS:
        parts = V.sum_vectors(parts, ["probe"]).select("probe", F.col("total").alias("vec"))
    table = parts.toArrow()
    out: dict[int, np.ndarray] = {}
    for k, vec in zip(table.column("probe").to_pylist(), table.column("vec")):
        part = vec.values.to_numpy(zero_copy_only=False)
        out[k] = out[k] + part if k in out else part
    return {k: (int(v[0]), float(v[1]), v[2:]) for k, v in out.items()}


def _direction(p: Probe) -> np.ndarray:
    """The quasi-Newton direction from the remembered steps."""
    q = p.slope.copy()
    kept = []
    for s, y, r in reversed(p.past):
        a = r * (s @ q)
        q -= a * y
        kept.append(a)
    if p.past:
        s, y, _ = p.past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y, r), a in zip(p.past, reversed(kept)):
        q += (a - r * (y @ q)) * s
    return -q


def train_probes(rows: DataFrame, names: list[str], probes: list[Probe], width: int, rounds: int = MAX_ITER, tolerance: float = 1e-4, memory: int = 10) -> None:
    """Fits the probes' weights (classes x (dims + 1), the intercept last) in place; those without training rows keep None.

    `rows` holds x first and then the integer columns `names`. Limited-memory
    quasi-Newton steps with backtracking, ended when no slope is above `tolerance`.
    """
    pieces = rows.rdd.getNumPartitions() if probes else 0
    for p in probes:
        p.dims = width if p.dims is None else p.dims
        p.trial = np.zeros((p.classes, p.dims + 1))
    for _ in range(rounds):
        asked = [(k, p) for k, p in enumerate(probes) if not p.done]
        if not asked:
            break
        found = _evaluate(rows, names, asked, pieces)
        for k, p in asked:
            if k not in found:
                p.done = True
                continue
            n, loss, grad = found[k]
            flat = p.trial.copy()
            flat[:, -1] = 0
            value, slope = loss / n + (flat * flat).sum() / (2 * n), grad / n + flat.ravel() / n
            if p.weights is not None and value > p.value + 1e-4 * p.step * (p.slope @ p.way):
                p.step /= 2
                if p.step < 1e-8:
                    p.done = True
                    continue
            else:
                if p.weights is not None:
                    s, y = (p.trial - p.weights).ravel(), slope - p.slope
                    if s @ y > 1e-12:
                        p.past = [*p.past[1 - memory :], (s, y, 1 / (s @ y))]
                p.rows, p.weights, p.value, p.slope, p.step = n, p.trial, value, slope, 1.0
                if np.abs(slope).max() <= tolerance:
                    p.done = True
                    continue
                p.way = _direction(p)
                if p.way @ p.slope >= 0:
                    p.past, p.way = [], -p.slope
            p.trial = p.weights + p.step * p.way.reshape(p.weights.shape)


def confusions(rows: DataFrame, names: list[str], probes: list[Probe], by: str | None = None) -> list[tuple[int, int, int, int, int]]:
    """(probe number, value of `by`, truth, predicted, rows) over each probe's test rows, from one pass."""
    models = [(k, p.label, p.test, p.dims, p.weights) for k, p in enumerate(probes) if p.weights is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, tags = _batch(batch, names)
            out = []
            for k, label, test, dims, w in models:
                own = _picked(tags, label, test)
                if own.any():
                    said = _scores(x[own][:, :dims], w).argmax(1)
                    group = tags[by][own] if by else np.zeros(len(said), np.int64)
                    cells, n = np.unique(np.stack([group, tags[label][own], said], axis=1), axis=0, return_counts=True)
                    out += [(k, *c, m) for c, m in zip(cells.tolist(), n.tolist())]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["probe", "grp", "truth", "said", "n"])

    parts = rows.mapInArrow(run, "probe long, grp long, truth long, said long, n long")
    return [tuple(r) for r in parts.groupBy("probe", "grp", "truth", "said").agg(F.sum("n").alias("n")).collect()]


def _right(cells: list[tuple], probe: int, group: int | None = None) -> tuple[int, int]:
    """Rows and right rows of a probe's confusions."""
    own = [c for c in cells if c[0] == probe and (group is None or c[1] == group)]
    return sum(c[4] for c in own), sum(c[4] for c in own if c[2] == c[3])


def tagged(df: DataFrame, labels: list[str], folds: int = 0, group: str | None = None, vec: str = "vec") -> tuple[DataFrame, list[str], dict[str, list[str]], int, DataFrame]:
    """Rows for training: x and integer columns (`is_<label>`, `fold_<label>`), their names, the levels, the dimension, what to unpersist.

    Rows without a vector are left out; a null label is -1.
    """
    rows = df.where(F.col(vec).isNotNull())
    levels = {c: levels_of(rows, c) for c in dict.fromkeys([*labels, *([group] if group else [])])}
    out = rows.select("line_no", F.col(vec).cast("array<double>").alias("x"), *[_code(c, v).cast("long").alias(f"is_{c}") for c, v in levels.items()])
    for c in labels if folds else ():
        out = resample.folds(out, f"is_{c}", "line_no", folds).withColumnRenamed("fold", f"fold_{c}")
    names = [f"is_{c}" for c in levels] + [f"fold_{c}" for c in labels if folds]
    # kept over the rounds; lost partitions are computed again
    kept = out.select("x", *[F.col(n).cast("long").alias(n) for n in names]).persist(StorageLevel.MEMORY_AND_DISK)
    n, first = kept.count(), kept.select(F.size("x")).first()
    return kept.coalesce(max(1, n // ROWS_PER_TASK)), names, levels, first[0] if first else 0, kept


def cross_validated_all(df: DataFrame, labels: list[str], k: int = 5, vec: str = "vec", dims: list[int] | None = None) -> dict[tuple[int | None, str], tuple[float | None, int, int]]:
    """L21 for many labels and leading dimensions at once: (dims, label) -> mean accuracy over folds, rows, levels.

    Folds are unshuffled and stratified. A fold without two classes to learn or
    rows to test does not count.
    """
    rows, names, levels, width, kept = tagged(df, labels, k, vec=vec)
    probes = [Probe(f"is_{c}", len(levels[c]), (f"fold_{c}", f, False), (f"fold_{c}", f, True), d) for d in dims or [None] for c in labels if len(levels[c]) > 1 for f in range(k)]
    train_probes(rows, names, probes, width)
    cells = confusions(rows, names, probes)
    counts = rows.agg(*[F.count_if(F.col(f"is_{c}") >= 0).alias(f"is_{c}") for c in labels]).first()
    out = {}
    for d in dims or [None]:
        for c in labels:
            mine = [i for i, p in enumerate(probes) if p.label == f"is_{c}" and p.dims == (width if d is None else d)]
            scored = [(right / n) for n, right in (_right(cells, i) for i in mine) if n]
            out[d, c] = (float(np.mean(scored)) if scored else None), counts[f"is_{c}"], len(levels[c])
    kept.unpersist()
    return out


def cross_validated(df: DataFrame, label: str, k: int = 5, vec: str = "vec") -> tuple[float | None, int, int]:
    """Mean accuracy over unshuffled stratified folds, rows, levels."""
    return cross_validated_all(df, [label], k, vec)[None, label]


def probe_report(df: DataFrame, labels: list[str], vec: str = "vec") -> DataFrame:
    """Label, n, levels, accuracy, chance."""
    found = cross_validated_all(df, labels, vec=vec)
    out = [(c, n, k, acc, 1.0 / k if k else None) for c in labels for acc, n, k in [found[None, c]]]
    return _frame(df, out, "label string, n long, levels int, accuracy double, chance double")


def leave_one_group_out(df: DataFrame, label: str, group: str, vec: str = "vec") -> DataFrame:
    """Held-out group, n, accuracy, chance, and mean and least accuracy over the groups."""
    rows, names, levels, width, kept = tagged(df, [label], group=group, vec=vec)
    groups = levels[group]
    probes = [Probe(f"is_{label}", len(levels[label]), (f"is_{group}", g, False), (f"is_{group}", g, True)) for g in range(len(groups))] if len(levels[label]) > 1 else []
    train_probes(rows, names, probes, width)
    cells = confusions(rows, names, probes)
    scored = [(g, *_right(cells, k)) for k, g in enumerate(groups)]
    accs = [right / n for _, n, right in scored if n]
    out = [(g, n, right / n, 1.0 / len(levels[label]), float(np.mean(accs)), min(accs)) for g, n, right in scored if n]
    kept.unpersist()
    return _frame(df, out, f"{group} string, n long, accuracy double, chance double, mean double, least double")


def transfer(df: DataFrame, label: str, group: str, sources: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """L23 (one source), L24 (all ordered pairs): source, target, n, accuracy, chance."""
    rows, names, levels, width, kept = tagged(df, [label], group=group, vec=vec)
    groups = levels[group]
    chosen = [g for g in range(len(groups)) if sources is None or groups[g] in sources]
    probes = [Probe(f"is_{label}", len(levels[label]), (f"is_{group}", g, True), (f"is_{group}", g, False)) for g in chosen] if len(levels[label]) > 1 else []
    train_probes(rows, names, probes, width)
    cells = confusions(rows, names, probes, f"is_{group}")
    out = []
    for k, g in enumerate(chosen):
        for t in range(len(groups)):
            n, right = _right(cells, k, t)
            if n:
                out.append((groups[g], groups[t], n, right / n, 1.0 / len(levels[label])))
    kept.unpersist()
    return _frame(df, out, "source string, target string, n long, accuracy double, chance double")


def transfer_summary(pairs: DataFrame, dense: tuple[str, ...]) -> DataFrame:
    """Mean over all pairs, over pairs across scripts, the worst pair, chance."""
    across = F.col("source").isin(*dense) != F.col("target").isin(*dense)
    return pairs.agg(F.count("*").alias("pairs"), F.avg("accuracy").alias("mean"), F.avg(F.when(across, F.col("accuracy"))).alias("across_scripts"), F.min("accuracy").alias("worst"), F.min("chance").alias("chance"))


def probe_errors(df: DataFrame, label: str, top: int = 5, vec: str = "vec") -> DataFrame:
    """Most frequent confusions of out-of-fold predictions."""
    rows, names, levels, width, kept = tagged(df, [label], 5, vec=vec)
    mine = levels[label]
    probes = [Probe(f"is_{label}", len(mine), (f"fold_{label}", f, False), (f"fold_{label}", f, True)) for f in range(5)] if len(mine) > 1 else []
    train_probes(rows, names, probes, width)
    wrong: dict[tuple[str, str], int] = {}
    for _, _, truth, said, n in confusions(rows, names, probes):
        if truth != said:
            wrong[mine[truth], mine[said]] = wrong.get((mine[truth], mine[said]), 0) + n
    kept.unpersist()
    out = sorted(((a, b, n) for (a, b), n in wrong.items()), key=lambda r: (-r[2], r[0], r[1]))[:top]
    return _frame(df, out, "truth string, predicted string, n long")


def _leading(df: DataFrame, dims: int, vec: str) -> tuple[DataFrame, int]:
    """df with the leading components as `low`, and how many there are (the data's at most)."""
    rows = df.where(F.col(vec).isNotNull()).withColumn("_features", array_to_vector(F.col(vec)))
    first, n = rows.select(F.size(vec)).first(), rows.count()
    k = min(dims, first[0] if first else 0, n - 1)
    if k < 1:
        return rows.withColumn("low", F.col(vec)).drop("_features"), 0
    low = PCA(k=k, inputCol="_features", outputCol="_low").fit(rows).transform(rows)
    return low.withColumn("low", vector_to_array("_low")).drop("_features", "_low"), k


def pca_probe(df: DataFrame, labels: list[str], dims: list[int], vec: str = "vec", cell: list[str] | None = None, cell_dims: list[int] | None = None) -> DataFrame:
    """Probe accuracy on the leading d components per label, over all records and, with `cell`, over one record per cell.

    The components are nested, so one decomposition serves all d. Dimensions
    above the data's are left out over all records and cut to them in the second half.
    """
    parts = [("all", df, dims, False)]
    if cell:
        kept = df.where(" and ".join(f"{c} is not null" for c in cell))
        parts.append(("one per cell", kept.join(resample.one_per_cell(kept, cell, "line_no").select("line_no"), "line_no", "left_semi"), cell_dims or dims, True))

    # the decomposition's library is not safe in threads side by side
    leading = [_leading(rows, max(wanted), vec) for _, rows, wanted, _ in parts]

    def half(name: str, wanted: list[int], cut: bool, low: DataFrame, k: int) -> list[tuple]:
        usable = [(d, min(d, k)) for d in wanted if k and (cut or d <= k)]
        if not usable:
            return []
        found = cross_validated_all(low, labels, vec="low", dims=sorted({m for _, m in usable}))
        return [(name, d, label, n, acc, 1.0 / c if c else None) for d, m in usable for label in labels for acc, n, c in [found[m, label]]]

    out = [row for rows in _side_by_side([lambda p=p, x=x: half(p[0], p[2], p[3], *x) for p, x in zip(parts, leading)]) for row in rows]
    return _frame(df, out, "records string, dims int, label string, n long, accuracy double, chance double")


def offset_check(clouds: dict[str, DataFrame], label: str, vec: str = "vec") -> DataFrame:
    """Cloud, n, levels, accuracy, chance, verdict: whether a probe still tells the label at more than twice chance."""
    found = _side_by_side([lambda rows=rows: cross_validated(rows, label, vec=vec) for rows in clouds.values()])
    out = []
    for name, (acc, n, k) in zip(clouds, found):
        verdict = "told" if acc is not None and k and acc > 2 / k else "removed"
        out.append((label, n, k, acc, 1.0 / k if k else None, name, verdict))
    any_rows = next(iter(clouds.values()))
    return _frame(any_rows, out, "label string, n long, levels int, accuracy double, chance double, cloud string, verdict string")


# --------------------------------------------------------------------------
# clusterings


def kmeans_labels(df: DataFrame, k: int, starts: int = 10, vec: str = "vec") -> DataFrame:
    """Rows with `cluster` of the best of several seeded starts."""
    rows = df.where(F.col(vec).isNotNull()).withColumn("features", array_to_vector(F.col(vec))).persist(StorageLevel.MEMORY_AND_DISK)
    models = _side_by_side([lambda s=s: KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster").fit(rows) for s in range(starts)])
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(rows).drop("features")


def style_slices(df: DataFrame, starts: int = 10, vec: str = "vec") -> DataFrame:
    """Per style the NMI of clusters with techniques, the probes of technique and language, and the NMI difference terse - verbose."""

    def one(style: str) -> tuple | None:
        part = df.where(F.col("style") == style).where("technique is not null").persist(StorageLevel.MEMORY_AND_DISK)
        k = len(levels_of(part, "technique"))
        if k < 2:
            return None
        clustered = kmeans_labels(part, k, starts, vec)
        nmi = stats.mutual_information(clustered.groupBy("technique", F.col("cluster").cast("string").alias("cluster")).agg(F.count("*").alias("n")), "technique", "cluster").first()["nmi"]
        probed = cross_validated_all(part, ["technique", "language"], vec=vec)
        part.unpersist()
        return style, probed[None, "technique"][1], float(nmi), probed[None, "technique"][0], probed[None, "language"][0]

    out = [r for r in _side_by_side([lambda s=s: one(s) for s in levels_of(df, "style")]) if r]
    nmi = {r[0]: r[2] for r in out}
    difference = nmi["terse"] - nmi["verbose"] if {"terse", "verbose"} <= set(nmi) else None
    return _frame(df, [(*r, difference) for r in out], "style string, n long, nmi double, technique_probe double, language_probe double, nmi_difference double")


def silhouette(df: DataFrame, label: str, id_col: str = "line_no", vec: str = "vec", block: int = 2048) -> float | None:
    """Mean of (b - a) / max(a, b) with Euclidean distances: a the mean one to the own level, b to the nearest other level.

    Every pair of records counts by definition: pairs of blocks are one matrix
    product each, which leaves one sum per record and level. Records alone in
    their level count 0. None for fewer than two levels.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    levels = levels_of(rows, label)
    if len(levels) < 2:
        return None
    coded = rows.select(id_col, vec, _code(label, levels).cast("int").alias("code"))
    blocks = max(1, -(-coded.count() // block))
    coded = coded.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    numbers = df.sparkSession.range(blocks).select(F.col("id").cast("int").alias("other"))
    pairs = numbers.select(F.col("other").alias("own")).join(numbers)
    left = coded.join(pairs, F.col("block") == F.col("own")).select("own", "other", F.lit(0).alias("side"), id_col, "code", vec)
    right = coded.join(pairs, F.col("block") == F.col("other")).select("own", "other", F.lit(1).alias("side"), id_col, "code", vec)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("code", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def run(table):
        import pandas as pd

        one, two = table[table.side == 0], table[table.side == 1]
        if not len(one) or not len(two):
            return pd.DataFrame({id_col: [], "code": [], "level": [], "d": []})
        x, y = np.stack(one[vec].to_numpy()), np.stack(two[vec].to_numpy())
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))
        d[one[id_col].to_numpy()[:, None] == two[id_col].to_numpy()[None, :]] = 0
        met = np.unique(two.code.to_numpy())
        sums = d @ (two.code.to_numpy()[:, None] == met[None, :]).astype(float)
        n = len(one)
        return pd.DataFrame({id_col: np.repeat(one[id_col].to_numpy(), len(met)), "code": np.repeat(one.code.to_numpy(), len(met)), "level": np.tile(met, n), "d": sums.ravel()})

    sums = left.unionByName(right).groupBy("own", "other").applyInPandas(run, schema).groupBy(id_col, "code", "level").agg(F.sum("d").alias("d"))
    sizes = coded.groupBy(F.col("code").alias("level")).agg(F.count("*").alias("n"))
    own = F.col("code") == F.col("level")
    each = sums.join(V.few(sizes), "level").groupBy(id_col).agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("d") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    value = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return each.agg(F.avg(F.coalesce(value, F.lit(0.0)))).first()[0]


def silhouette_probe(df: DataFrame, label: str, vec: str = "vec") -> DataFrame:
    """Accuracy, lift over chance, silhouette (Euclidean) of a labelling."""
    acc, n, k = cross_validated(df, label, vec=vec)
    return _frame(df, [(label, n, acc, acc * k if acc is not None else None, silhouette(df, label, vec=vec))], "label string, n long, accuracy double, lift double, silhouette double")


# --------------------------------------------------------------------------
# probes on words


def fit(train: DataFrame, max_iter: int = MAX_ITER) -> LogisticRegressionModel | None:
    """None when the training rows hold fewer than two classes."""
    n, k = train.agg(F.count("*"), F.count_distinct("y")).first()
    if k < 2:
        return None
    train = train.coalesce(max(1, n // ROWS_PER_TASK))  # few rows in many tasks cost more than the sums
    return LogisticRegression(featuresCol="features", labelCol="y", maxIter=max_iter, regParam=1.0 / n, standardization=False, family="multinomial", tol=1e-5).fit(train)


def accuracy(model: LogisticRegressionModel | None, test: DataFrame) -> float | None:
    if model is None:
        return None
    r = model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    return None if r is None else float(r)


def lexical_vectors(df: DataFrame, terms: Column, min_df: int = 2, fit_on: Column | None = None, most: int = MAX_VOCABULARY) -> tuple[DataFrame, list[str]]:
    """df with `features`: TF-IDF vectors of unit length, and the vocabulary in the vectors' order.

    Vocabulary and weights come from the rows where `fit_on` holds. A row
    without any of its terms has the zero vector, as all have where no term
    occurs in `min_df` rows; more than `most` terms are refused.
    """
    rows = df.withColumn("_terms", F.coalesce(terms, F.array().cast("array<string>")))
    base = rows if fit_on is None else rows.where(fit_on)
    held = base.select(F.explode(F.array_distinct("_terms")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= min_df)
    size = held.count()
    if size > most:
        raise ValueError(f"more than {most} terms")
    if not size:
        return rows.withColumn("features", array_to_vector(F.array(F.lit(0.0)))).drop("_terms"), []
    counter = CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=float(min_df), vocabSize=size).fit(base)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(base)).idf.toArray() + 1
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w").transform(counter.transform(rows))
    return Normalizer(p=2.0, inputCol="_w", outputCol="features").transform(weighed).drop("_terms", "_tf", "_w"), list(counter.vocabulary)


def _labelled(df: DataFrame, label: str, levels: list[str]) -> DataFrame:
    return df.withColumn("y", _code(label, levels).cast("double"))


def lexical_baseline(df: DataFrame, language: str, kinds: dict[str, Column | None], min_df: int = 2) -> DataFrame:
    """Per representation (words, characters, vectors: None) the mean accuracy of train on one style, test on the other, both ways."""
    rows = df.where((F.col("language") == language) & F.col("technique").isNotNull() & F.col("style").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    levels = levels_of(rows, "technique")

    def score(kind: str, train: str, test: str) -> float | None:
        terms = kinds[kind]
        f = rows.withColumn("features", array_to_vector("vec")) if terms is None else lexical_vectors(rows, terms, min_df, F.col("style") == train)[0]
        if not levels:
            return None
        f = _labelled(f, "technique", levels).select("style", "y", "features").persist(StorageLevel.MEMORY_AND_DISK)
        s = accuracy(fit(f.where(F.col("style") == train)), f.where(F.col("style") == test))
        f.unpersist()
        return s

    runs = [(k, a, b) for k in kinds for a, b in (("terse", "verbose"), ("verbose", "terse"))]
    scores = _side_by_side([lambda r=r: score(*r) for r in runs])
    n = rows.count()
    rows.unpersist()
    out = []
    for kind in kinds:
        got = [s for (k, _, _), s in zip(runs, scores) if k == kind and s is not None]
        out.append((kind, n, sum(got) / len(got) if got else None, 1.0 / len(levels) if levels else None))
    return _frame(df, out, "representation string, n long, accuracy double, chance double")


def term_weights(df: DataFrame, language: str, terms: Column, min_df: int = 2) -> tuple[np.ndarray, list[str]]:
    """Weights (classes x terms) of a technique probe on the terse rows of one language, and the terms."""
    rows = df.where((F.col("language") == language) & (F.col("style") == "terse") & F.col("technique").isNotNull())
    levels = levels_of(rows, "technique")
    vecs, names = lexical_vectors(rows, terms, min_df) if len(levels) > 1 else (None, [])
    if not names:
        return np.zeros((0, 0)), []
    model = fit(_labelled(vecs, "technique", levels).select("y", "features"))
    return model.coefficientMatrix.toArray(), names


def heaviest_terms(weights: np.ndarray, names: list[str], topk: int) -> list[str]:
    """max(1, topk // classes) terms of each class, without duplicates, longest first, then by name; at most topk."""
    if not len(weights):
        return []
    per = max(1, topk // len(weights))
    picked = {names[k] for row in weights for k in sorted(range(len(names)), key=lambda k: (-round(row[k], 9), names[k]))[:per]}
    return sorted(picked, key=lambda t: (-len(t), t))[:topk]


def analyser(language: str, dense: tuple[str, ...], text: str = "proof") -> Column:
    """Words, or character n-grams of 2 to 4 in scripts without spaces."""
    return lexical.char_terms(text, 2, 4) if language in dense else lexical.word_terms(text)


def terms_by_language(df: DataFrame, languages: tuple[str, ...], dense: tuple[str, ...], topk: int = 400) -> dict[str, list[str]]:
    """L30 for each language with its own analyser."""
    found = _side_by_side([lambda lang=lang: heaviest_terms(*term_weights(df, lang, analyser(lang, dense)), topk) for lang in languages])
    return dict(zip(languages, found))


def discriminative_terms(df: DataFrame, languages: tuple[str, ...], dense: tuple[str, ...], topk: int = 400) -> DataFrame:
    """Language, place, term: the heaviest terms of each class in a probe on terse rows of the language."""
    rows = [(lang, k, t) for lang, terms in terms_by_language(df, languages, dense, topk).items() for k, t in enumerate(terms, 1)]
    return _frame(df, rows, "language string, place int, term string")


def masking_sweep(df: DataFrame, language: str, sizes: list[int], dense: tuple[str, ...] = ()) -> DataFrame:
    """K, terms, text kept, accuracy: mask the k heaviest terms, train on terse, test on verbose rows.

    The term weights do not depend on k and are fitted once. Texts masked to
    nothing are scored like all others.
    """
    rows = df.where((F.col("language") == language) & F.col("technique").isNotNull() & F.col("style").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    levels = levels_of(rows, "technique")
    weights, names = term_weights(df, language, analyser(language, dense))

    def one(k: int) -> tuple:
        chosen = heaviest_terms(weights, names, k) if k else []
        masked = rows.withColumn("whole", F.col("proof")).withColumn("proof", lexical.mask("proof", chosen, language not in dense))
        kept = masked.agg(F.sum(F.length(F.replace("proof", F.lit(lexical.PLACEHOLDER), F.lit("")))) / F.sum(F.length("whole"))).first()[0]
        acc = None
        vecs, _ = lexical_vectors(masked, lexical.word_terms("proof", 2), fit_on=F.col("style") == "terse")
        if len(levels) > 1:
            f = _labelled(vecs, "technique", levels).select("style", "y", "features").persist(StorageLevel.MEMORY_AND_DISK)
            acc = accuracy(fit(f.where("style = 'terse'")), f.where("style = 'verbose'"))
            f.unpersist()
        return k, len(chosen), None if kept is None else float(kept), acc

    out = _side_by_side([lambda k=k: one(k) for k in sizes])
    rows.unpersist()
    return _frame(df, out, "k int, terms int, kept double, accuracy double")


def masking_ablation(df: DataFrame, embed: Callable[[DataFrame], DataFrame], languages: tuple[str, ...], dense: tuple[str, ...], topk: int = 400) -> DataFrame:
    """Texts (unmasked, masked, drop), pairs, mean, across_scripts, worst, chance.

    Each language's heaviest terms are masked, the texts embedded again, and
    probes of every language carried over to every other.
    """
    rows = df.where(F.col("language").isin(*languages))
    terms = {k: v for k, v in terms_by_language(rows, languages, dense, topk).items() if v}
    labels = rows.select("line_no", "technique", "language")
    parts = {}
    for name, texts in (("unmasked", rows), ("masked", lexical.mask_by_language(rows, terms, dense).withColumn("proof", F.col("masked")))):
        vecs = embed(texts).join(labels, "line_no")
        parts[name] = transfer_summary(transfer(vecs, "technique", "language"), dense).first()
    measures = ("mean", "across_scripts", "worst")
    out = [(n, p["pairs"], *(p[m] for m in measures), p["chance"]) for n, p in parts.items()]
    drop = [None if parts["unmasked"][m] is None or parts["masked"][m] is None else parts["unmasked"][m] - parts["masked"][m] for m in measures]
    out.append(("drop", parts["unmasked"]["pairs"], *drop, None))
    return _frame(df, out, "texts string, pairs long, mean double, across_scripts double, worst double, chance double")
