import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import vectors as V
from corpusloom.operators import assignment, geometry, kernels, probes, resample


def planted(seed=0, noise=0.05, dim=12, reps=5):
    """Technique, language and style offsets, an extreme arm and a centre cell."""
    rng = np.random.default_rng(seed)
    tech = {f"t{k}": rng.normal(size=dim) for k in range(3)}
    lang = {x: 2 * rng.normal(size=dim) for x in ("de", "en", "fr", "ja")}
    style = {x: 0.2 * rng.normal(size=dim) for x in ("terse", "verbose")}
    rows, n = [], 0
    for t, a in tech.items():
        for g, b in lang.items():
            for s, c in style.items():
                for _ in range(reps):
                    x = a + b + c + noise * rng.normal(size=dim)
                    rows.append((n, "technique", "own", t, None, g, s, (x / np.linalg.norm(x)).tolist()))
                    n += 1
    for d, t in (("up", "t0"), ("down", "t1"), ("side", "t2")):
        for g, b in lang.items():
            for _ in range(reps):
                x = tech[t] + b + noise * rng.normal(size=dim)
                rows.append((n, "extreme", "own", None, d, g, None, (x / np.linalg.norm(x)).tolist()))
                n += 1
    for g, b in lang.items():
        x = sum(tech.values()) / 3 + b
        rows.append((n, "scope", "own", None, None, g, None, (x / np.linalg.norm(x)).tolist()))
        n += 1
    return rows


SCHEMA = "line_no long, arm string, theorem string, technique string, direction string, language string, style string, vec array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(planted(), SCHEMA).cache()


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(V.dot("a", "b").alias("d"), V.norm("a").alias("n"), V.unit("a").alias("u"), V.minus("a", "b").alias("m")).collect()
    assert got[0]["d"] == 3.0 and got[0]["n"] == 5.0 and got[0]["u"] == [0.6, 0.8] and got[0]["m"] == [2.0, 4.0]
    assert got[1]["u"] == [0.0, 0.0] and got[2]["d"] is None


def test_mean_and_sum(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None), (None, [5.0, 5.0])], "k string, vec array<double>")
    got = {r["k"]: r for r in V.sum_vectors(df, ["k"]).collect()}
    assert got["a"]["total"] == [4.0, 6.0] and got["a"]["squares"] == 30.0 and None in got and "b" not in got
    assert V.mean_vectors(df.limit(0), ["k"]).count() == 0


def test_leave_one_out_equals_naive(rows):
    got = {r["line_no"]: np.array(r["vec"]) for r in geometry.centre_leave_one_out(rows, "language", ["line_no"]).collect()}
    data = rows.select("line_no", "language", "vec").collect()
    for r in data[::17]:
        peers = np.array([q["vec"] for q in data if q["language"] == r["language"] and q["line_no"] != r["line_no"]])
        x = np.array(r["vec"]) - peers.mean(0)
        assert np.allclose(got[r["line_no"]], x / np.linalg.norm(x), atol=1e-9)


def test_leave_one_out_drops_single_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "b", [0.0, 1.0])], "line_no long, language string, vec array<double>")
    assert {r["line_no"] for r in geometry.centre_leave_one_out(df, "language", ["line_no"]).collect()} == {2, 3}


def test_assignment_is_exact_on_planted_rows(rows):
    c = assignment.centred(rows, ["line_no", "arm", "theorem", "technique", "direction", "style"])
    got = assignment.assign(c.where("arm = 'extreme'"), assignment.centroids(c), ["direction"]).select("direction", "best").distinct().collect()
    assert {(r["direction"], r["best"]) for r in got} == {("up", "t0"), ("down", "t1"), ("side", "t2")}
    one = assignment.association(assignment.assign(c.where("arm = 'extreme'"), assignment.centroids(c), ["direction"])).first()
    assert one["cramers_v"] == pytest.approx(1.0) and one["dof"] == 4


def test_pair_similarity_equals_brute_force(rows):
    data = rows.where("arm = 'technique'").collect()
    x = np.array([r["vec"] for r in data])
    cos = x @ x.T
    i, j = np.triu_indices(len(x), 1)
    got = {r["factor"]: r for r in geometry.pair_similarity(rows.where("arm = 'technique'"), ["technique", "language"]).collect()}
    for f in ("technique", "language"):
        lab = np.array([r[f] for r in data])
        same = lab[i] == lab[j]
        assert got[f]["same"] == pytest.approx(cos[i, j][same].mean()) and got[f]["diff"] == pytest.approx(cos[i, j][~same].mean())


def test_furthest_pair_equals_brute_force(spark, rows):
    rng = np.random.default_rng(3)
    data = rows.orderBy("line_no").collect()
    x = np.array([r["vec"] for r in data])
    cos = np.round(x @ x.T, 9)
    bounded = spark.createDataFrame([(k, [1.0, 0.02 * rng.random(), 0.02 * rng.random()]) for k in range(100)] + [(200, [1.0, 0.3, 0.0]), (201, [1.0, -0.3, 0.0])], "line_no long, vec array<double>")
    assert tuple(geometry.furthest_pair(bounded, "line_no", block=37).first())[:2] == (200, 201)
    got = geometry.furthest_pair(rows, "line_no", block=37).first()
    assert got["cos"] == pytest.approx(cos.min()) and cos[got["a"], got["b"]] == pytest.approx(cos.min()) and got["a"] < got["b"]


def test_empty_and_null_inputs(spark, rows):
    none = rows.limit(0)
    assert geometry.variance_budget(none, [["technique"]]).first()["fraction"] is None
    assert geometry.pair_similarity(none, ["technique"]).first()["same"] is None
    assert geometry.spectrum(none, "technique").count() == 0
    assert geometry.furthest_pair(none, "line_no").count() == 0
    assert geometry.polar_angles(none, "line_no").count() == 0
    assert assignment.assign(none, assignment.centroids(none), ["line_no"]).count() == 0
    assert stats.chi_square(spark.createDataFrame([], "r string, c string, n long"), "r", "c").first()["total"] == 0


def test_spectrum_and_angles(spark, rows):
    two = rows.where("arm = 'technique' and technique <> 't2'")
    s = geometry.spectrum(two, "technique").collect()
    assert len(s) == 1 and s[0]["fraction"] == pytest.approx(1.0) and s[0]["verdict"] == "one"
    assert sum(r["fraction"] for r in geometry.spectrum(rows.where("arm = 'technique'"), "language").collect()) == pytest.approx(1.0)
    same = rows.where("arm = 'technique'").withColumn("copy", F.col("technique"))
    assert geometry.subspace_angles(same, ["technique", "copy"]).first()["greatest"] < 1e-4
    null = geometry.angle_null(rows.where("arm = 'technique'"), "technique", "language", ["language", "style"], 20)
    got = {r["null"]: r for r in null.collect()}
    assert set(got) == {"permuted", "random"} and 0 <= got["random"]["p"] <= 1


def test_hull():
    p = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    lam, r = kernels.hull_residual(p, p.mean(0))
    assert r < 1e-3 or np.allclose(lam.sum(), 1, atol=1e-4)
    assert np.linalg.norm(lam @ p - p.mean(0)) < 1e-5
    assert kernels.hull_residual(p, np.array([2.0, 2, 2]))[1] > 0.5
    assert kernels.hull_residual(np.zeros((0, 3)), np.ones(3))[1] == float("inf")


def test_mixture_against_brute_force():
    rng = np.random.default_rng(1)
    grid = np.array([(a, b, c, 40 - a - b - c) for a in range(41) for b in range(41 - a) for c in range(41 - a - b)]) / 40
    for k in range(20):
        points, q = rng.normal(size=(4, 3)), rng.normal(size=3) * (0.3 if k % 2 else 2)
        if k == 7:
            points[2] = points[1]  # a repeated point
        weights, r = kernels.hull_residual(points, q)
        best = np.linalg.norm(grid @ points - q, axis=1).min()
        reach = np.linalg.norm(q - points.mean(0))
        assert weights.min() >= 0 and weights.sum() == pytest.approx(1.0)
        assert np.linalg.norm(weights @ points - q) == pytest.approx(r * reach, abs=1e-6) and r * reach <= best + 1e-9 and best - r * reach < 0.12


def test_hull_bootstrap_runs(rows):
    c = assignment.centred(rows, ["line_no", "arm", "theorem", "technique", "direction", "style"])
    got = kernels.hull_bootstrap(c, "own", replicates=10).first()
    assert got["replicates"] == 10 and 0 <= got["inside"] <= 1
    assert kernels.hull_bootstrap(c.limit(0), "own", replicates=10).first()["replicates"] == 0


def test_bootstrap_means_scatter_like_resamples(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "line_no long, cell string, vec array<double>")
    got = resample.bootstrap_means(df, "cell", "line_no", 400).collect()
    means = np.array([r["mean"] for r in got])
    assert len(got) == 400 and np.allclose(means.mean(0), x.mean(0), atol=0.02) and np.allclose(means.std(0), x.std(0) / np.sqrt(200), rtol=0.2)
    again = {r["replicate"]: r["mean"] for r in resample.bootstrap_means(df.repartition(5), "cell", "line_no", 400).collect()}
    assert all(np.allclose(again[r["replicate"]], r["mean"]) for r in got)


def test_small_cells_are_drawn_exactly(spark):
    df = spark.createDataFrame([(k, c, [float(k)]) for k, c in enumerate("abbbcccccccccc")], "line_no long, cell string, vec array<double>")
    got = resample.bootstrap_means(df, "cell", "line_no", 300).collect()
    size = {"a": 1, "b": 3, "c": 10}
    assert len(got) == 900 and all(r["weight"] == size[r["cell"]] for r in got)
    means = np.array([r["mean"][0] for r in got if r["cell"] == "c"])
    assert abs(means.mean() - 8.5) < 0.2 and abs(means.std() - np.arange(4, 14).std() / np.sqrt(10)) < 0.12


def test_shuffled_places_are_bijections():
    salts = np.arange(1, 30)
    for n in (1, 2, 3, 7, 64, 101):
        at = resample.shuffled_places(np.arange(n), np.full(n, n), salts)
        assert (np.sort(at, axis=0) == np.arange(n)[:, None]).all()
    at = resample.shuffled_places(np.arange(5), np.full(5, 5), np.arange(4000))
    assert abs(at.mean(1) - 2).max() < 0.15  # no place is favoured


def test_shuffled_means_keep_the_cells(rows):
    arm = rows.where("arm = 'technique'")
    data = arm.collect()
    got = resample.shuffled_means(arm, "technique", ["language", "style"], "line_no", 6).collect()
    assert len(got) == 18 and all(r["weight"] == 40 for r in got)
    # labels keep their numbers in each cell, so the means of a replicate average to the mean of all
    whole = np.mean([r["vec"] for r in data], axis=0)
    for k in range(6):
        assert np.allclose(np.mean([r["mean"] for r in got if r["replicate"] == k], axis=0), whole)
    assert not np.allclose(got[0]["mean"], got[1]["mean"])


def test_tail_of_chi_square():
    # the known 95 % points, and the exact tails of two and four degrees of freedom
    for x, dof in ((3.841459, 1), (5.991465, 2), (14.067140, 7), (82.528727, 63)):
        assert stats.chi_square_tail(x, dof) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(560.0, 2) == pytest.approx(np.exp(-280)) and stats.chi_square_tail(8.0, 4) == pytest.approx(5 * np.exp(-4))
    assert stats.chi_square_tail(0.0, 3) == 1.0


def test_probe_weights_solve_the_problem(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    y = (x @ rng.normal(size=(3, 3)) + rng.normal(size=(90, 3))).argmax(1)
    df = spark.createDataFrame([(k, f"c{c}", v.tolist()) for k, (v, c) in enumerate(zip(x, y))], "line_no long, lab string, vec array<double>")
    data, names, levels, width, kept = probes.tagged(df, ["lab"], 3)
    one = [probes.Probe("is_lab", 3, ("fold_lab", 0, False), ("fold_lab", 0, True)), probes.Probe("is_lab", 3, ("fold_lab", 1, False), ("fold_lab", 1, True), 2)]
    probes.train_probes(data, names, one, width, tolerance=1e-7)
    fold = {r["line_no"]: r["fold"] for r in resample.folds(df, "lab", "line_no", 3).collect()}
    for p, f, d in ((one[0], 0, 3), (one[1], 1, 2)):
        own = np.array([fold[k] != f for k in range(90)])
        w = np.zeros((3, d + 1))
        for _ in range(6000):
            z = x[own][:, :d] @ w[:, :-1].T + w[:, -1]
            e = np.exp(z - z.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            e[np.arange(own.sum()), y[own]] -= 1
            w -= 0.5 * (np.c_[e.T @ x[own][:, :d], e.sum(0)] / own.sum() + np.c_[w[:, :-1], np.zeros(3)] / own.sum())
        assert np.allclose(p.weights - p.weights.mean(0), w - w.mean(0), atol=1e-3)
    kept.unpersist()


def test_silhouette_against_brute_force(rows):
    arm = rows.where("arm = 'technique'")
    data = arm.collect()
    x, lab = np.array([r["vec"] for r in data]), np.array([r["technique"] for r in data])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(len(x)):
        a = d[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    assert probes.silhouette(arm, "technique", block=50) == pytest.approx(np.mean(s))
    assert probes.silhouette(arm.where("technique = 't0'"), "technique") is None


def test_word_probes_keep_rows_without_terms(spark):
    texts = [("t0", "red apple tree"), ("t1", "blue whale sea")]
    rows = [(k, t, "en", s, f"{text} {s if k % 3 else ''}", [float(k % 2), 1.0]) for k, (t, text, s) in enumerate((t, x, s) for _ in range(6) for t, x in texts for s in ("terse", "verbose"))]
    rows.append((99, "t1", "en", "verbose", "qqq", [0.0, 1.0]))
    df = spark.createDataFrame(rows, "line_no long, technique string, language string, style string, proof string, vec array<double>")
    vecs, names = probes.lexical_vectors(df, probes.lexical.word_terms("proof"), fit_on=F.col("style") == "terse")
    got = {r["line_no"]: r["features"] for r in vecs.collect()}
    assert len(got) == len(rows) and got[99].numNonzeros() == 0 and all(v.norm(2) == pytest.approx(1.0) for k, v in got.items() if k != 99)
    base = {r["representation"]: r for r in probes.lexical_baseline(df, "en", {"words": probes.lexical.word_terms("proof"), "vectors": None}).collect()}
    assert base["words"]["accuracy"] > 0.95 and base["words"]["n"] == len(rows)
    sweep = probes.masking_sweep(df, "en", [0, 400]).orderBy("k").collect()
    assert sweep[0]["accuracy"] > 0.9 and sweep[1]["accuracy"] < 0.7 and sweep[1]["kept"] < sweep[0]["kept"] == 1.0
    assert probes.discriminative_terms(df.limit(0), ("en", "ja"), ("ja",)).count() == 0


def test_probes_on_planted_signal(rows):
    arm = rows.where("arm = 'technique'")
    got = {r["label"]: r for r in probes.probe_report(arm, ["technique"]).collect()}
    assert got["technique"]["accuracy"] == pytest.approx(1.0)
    centred = assignment.centred(rows, ["line_no", "arm", "technique", "style"]).where("arm = 'technique'")
    assert probes.cross_validated(centred, "language")[0] < 0.5
    loo = probes.leave_one_group_out(arm, "technique", "language").collect()
    assert len(loo) == 4 and all(r["chance"] == pytest.approx(1 / 3) for r in loo)
    assert probes.transfer(arm, "technique", "language", ["en"]).count() == 3


def test_probe_without_classes(rows):
    assert probes.probe_report(rows.limit(0), ["technique"]).first()["accuracy"] is None


def test_resampling(spark):
    df = spark.createDataFrame([(k, f"c{k % 2}", f"l{k % 3}") for k in range(30)], "line_no long, cell string, lab string")
    s = resample.shuffled_labels(df, "line_no", "lab", ["cell"], 3)
    assert s.count() == 90
    a = s.groupBy("replicate").agg(F.sort_array(F.collect_list("shuffled")).alias("x")).collect()
    assert all(r["x"] == sorted(f"l{k % 3}" for k in range(30)) for r in a)
    assert resample.one_per_cell(df, ["cell"], "line_no").count() == 2
    f = resample.folds(df, "lab", "line_no")
    assert f.groupBy("lab", "fold").count().agg(F.max("count")).first()[0] == 2


def test_nmi(spark):
    same = spark.createDataFrame([("a", "x", 5), ("b", "y", 7)], "r string, c string, n long")
    assert stats.mutual_information(same, "r", "c").first()["nmi"] == pytest.approx(1.0)
    free = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "x", 5), ("b", "y", 5)], "r string, c string, n long")
    assert abs(stats.mutual_information(free, "r", "c").first()["nmi"]) < 1e-12


def test_exact_quantile(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=500).tolist(), [1.0] * 400 + [2.0] * 100, [5.0], (rng.pareto(1, 300) * 1e6).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.05, 0.5, 0.973, 1.0):
            assert stats.exact_quantile(df, "v", q, bins=8, small=20) == pytest.approx(np.quantile(values, q))
    assert stats.exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_null_from_margins_agrees_with_shuffles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"r{rng.integers(3)}", f"c{rng.integers(4)}") for k in range(150)]
    df = spark.createDataFrame(rows, "line_no long, direction string, best string")
    a, b = (np.unique([r[k] for r in rows], return_inverse=True)[1] for k in (1, 2))

    def chi(x, y):
        t = np.histogram2d(x, y, bins=(3, 4))[0]
        return 150 * (t * t / np.outer(t.sum(1), t.sum(0))).sum() - 150

    shuffled = np.array([chi(a, rng.permutation(b)) for _ in range(3000)])
    got = assignment.permutation_null(df, "direction", "best", 4000).first()
    assert got["observed"] == pytest.approx(chi(a, b)) and abs(got["null_mean"] - shuffled.mean()) < 0.3 and abs(got["p"] - (shuffled >= chi(a, b) - 1e-9).mean()) < 0.05
    assert assignment.permutation_null(df.limit(0), "direction", "best").count() == 0
    one = assignment.null_agreement(df, "direction", "best", 4000).first()
    assert one["agrees"] and one["exact_mean"] == pytest.approx(150 / 149 * 6)


def test_places_cross_parts(spark):
    rows = [(k * 70_000, "a" if k % 3 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "line_no long, cell string")
    got = resample.place_within(df, ["cell"], [F.col("line_no")], resample.number_part("line_no")).collect()
    for cell in ("a", None):
        part = sorted((r["line_no"], r["place"]) for r in got if r["cell"] == cell)
        assert [p for _, p in part] == list(range(len(part)))


def test_nearest_levels_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    c = rng.normal(size=(9, 4))
    c[5] = c[2]  # a tie: the first name wins
    x = rng.normal(size=(60, 4))
    levels = spark.createDataFrame([(f"l{k}", v.tolist()) for k, v in enumerate(c)], "lvl string, m array<double>")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "line_no long, vec array<double>")
    cos = np.round(x @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9)
    for size in (10**6, 8, 4):
        monkeypatch.setattr(V, "BLOCK_ELEMENTS", size)
        got = sorted(tuple(r) for r in V.nearest_levels(df, levels, "lvl", "m", ["line_no"]).collect())
        assert len(got) == 60
        for i, best, top, second, margin in got:
            s = np.sort(cos[i])
            assert best == f"l{cos[i].argmax()}" and top == s[-1] and second == s[-2] and margin == pytest.approx(s[-1] - s[-2])
    one = V.nearest_levels(df, levels.where("lvl = 'l0'"), "lvl", "m", ["line_no"]).first()
    assert one["best"] == "l0" and one["second_cos"] is None and one["margin"] is None
    assert V.nearest_levels(df, levels.limit(0), "lvl", "m", ["line_no"]).count() == 0


def test_fitted_queries_have_the_reference_parameters(monkeypatch):
    from corpusloom.plans import catalog

    class Rows:
        def where(self, _):
            return self

    for name in ("vectors", "_centred", "_assigned"):
        monkeypatch.setattr(catalog, name, lambda *a: Rows())
    monkeypatch.setattr(catalog, "_tidy", lambda rows: rows)
    for module, name in ((assignment, "permutation_null"), (geometry, "angle_null"), (kernels, "hull_bootstrap"), (probes, "pca_probe"), (probes, "discriminative_terms"), (probes, "masking_sweep"), (probes, "masking_ablation"), (probes, "style_slices")):
        monkeypatch.setattr(module, name, lambda *a, **k: [*a, k])
    ran = {name: catalog.queries()[name](None, "") for name in ("L8_permutation_null", "L18_angle_null", "L14_hull_bootstrap", "L19_pca_probe", "L30_discriminative_terms", "L32_masking_ablation", "L33_masking_sweep", "L27_style_slices")}
    assert ran["L8_permutation_null"][-2] == 20_000 and ran["L18_angle_null"][-2] == 200 and ran["L14_hull_bootstrap"][-1] == {"replicates": 1000}
    assert ran["L19_pca_probe"][2] == [2, 5, 10, 20, 50] and ran["L19_pca_probe"][-1]["cell_dims"] == [5, 10, 20]
    assert ran["L30_discriminative_terms"][-2] == ran["L32_masking_ablation"][-2] == 400 and ran["L33_masking_sweep"][2] == [0, 10, 50, 100, 400] and ran["L27_style_slices"][-2] == 10
    assert probes.MAX_ITER == 3000
