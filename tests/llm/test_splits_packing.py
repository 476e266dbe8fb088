import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import packing, splits

TECHNIQUES = [("product_counting", "multiply the list together, then count"), ("residue_ladder", "work with remainders, then climb"), ("coprime_tower", "build coprime numbers, then stack")]


def test_reading_labels():
    t = splits.Techniques(TECHNIQUES)
    for label in ("product_counting", "PRODUCT_COUNTING", "Product counting", "productCounting", "product-counting", "counting_product", "produ._counting", "prodcut_counting", "product_conting", " product_counting"):
        assert t.from_label(label) == "product_counting", label
    assert [t.from_label(x) for x in (None, "", "?", "something else")] == [None] * 4
    assert t.from_prompt("Required approach: work with remainders; then climb.") == "residue_ladder"
    assert t.from_id("t__coprime_tower__en__terse__0") == "coprime_tower" and t.from_id("opaque") is None
    assert [splits.style_of(x, None) for x in ("TERSE", "t", "verbsoe", "expanded", None)] == ["terse", "terse", "verbose", "verbose", None]
    assert splits.style_of(None, "Explain each idea at length.") == "verbose"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from("abc"), st.integers(1, 20)), min_size=1, max_size=25, unique_by=lambda x: x[:2]))
def test_quotas_are_integral_and_near(bundles):
    shares = [0.8, 0.1, 0.1]
    q = splits.flow_quotas(bundles, shares)
    total, biggest = sum(s * n for s, _, n in bundles), max(s for s, _, _ in bundles)
    for s, p, n in bundles:
        assert sum(q[s, p]) == n and min(q[s, p]) >= 0
    for k, x in enumerate(shares):
        assert abs(sum(s * q[s, p][k] for s, p, _ in bundles) - x * total) <= 2 * biggest


def brute_force(bundles, shares, weight=0.5):
    total, per = sum(s * n for s, _, n in bundles), defaultdict(int)
    for s, p, n in bundles:
        per[p] += s * n
    ways = [[(a, b, n - a - b) for a in range(n + 1) for b in range(n + 1 - a)] for _, _, n in bundles]
    best = float("inf")
    for way in itertools.product(*ways):
        have, inside = [0] * 3, defaultdict(lambda: [0] * 3)
        for (s, p, _), w in zip(bundles, way):
            for k in range(3):
                have[k] += s * w[k]
                inside[p][k] += s * w[k]
        best = min(best, sum((h - x * total) ** 2 for h, x in zip(have, shares)) + weight * sum((v[k] - shares[k] * per[p]) ** 2 for p, v in inside.items() for k in range(3)))
    return best


def cost_of(bundles, quotas, shares, weight=0.5):
    net = splits._Network(bundles, shares, weight)
    net.given = splits.np.array([quotas[s, p] for s, p, _ in bundles])
    return net.cost()


def test_quotas_equal_brute_force(monkeypatch):
    rng, shares, worse = random.Random(1), [0.8, 0.1, 0.1], 0
    for case in range(300):
        sizes = {(rng.randint(1, 9), rng.choice("ab")): rng.randint(1, 4) for _ in range(rng.randint(1, 3))}
        bundles = [(s, p, n) for (s, p), n in sizes.items()]
        best = brute_force(bundles, shares)
        assert cost_of(bundles, splits.flow_quotas(bundles, shares), shares) == pytest.approx(best)
        if case < 100:  # the network's own steps, which larger ones rely on
            net = splits._Network(bundles, shares, 0.5)
            net.augment()
            net.cancel()
            worse += net.cost() > best + 1e-6
            assert net.given.sum(1).tolist() == [n for _, _, n in bundles] and net.given.min() >= 0
    assert worse <= 15
    assert cost_of([(2, "a", 2), (3, "a", 3), (9, "a", 4)], splits.flow_quotas([(2, "a", 2), (3, "a", 3), (9, "a", 4)], shares), shares) == pytest.approx(0.09)


def test_split_keeps_cells(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 30) for _ in range(300)] + [2500]  # one cell holds a third
    rows = [(f"c{k}", rng.choice(["en", "fr"]) if k < 300 else None) for k, n in enumerate(sizes)]
    flat = [(c, lang) for (c, lang), n in zip(rows, sizes) for _ in range(n)]
    df = spark.createDataFrame(flat, "cell string, lang string")
    got = splits.split_components(df, ["cell"], "lang", [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    assert got.count() == 301 and got.select("cell").distinct().count() == 301
    by = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert abs(by["train"] / len(flat) - 0.8) < 0.02 and abs(by["test"] / len(flat) - 0.1) < 0.02
    again = splits.split_components(df.orderBy(F.rand(1)), ["cell"], "lang", [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert splits.split_components(df.limit(0), ["cell"], "lang", [("train", 1.0)]).count() == 0


def test_cells_of_records(spark):
    p = "Follow this line only: multiply the list together, then count. Be brief and formal.\nWrite everything in English."
    rows = [
        (1, "t__product_counting__en__terse__0", "technique", "product_counting", "terse", "en", p), (2, "op", "technique", "prodcut_counting", None, "fr", p),
        (3, "op", "extreme", None, None, "en", p), (4, None, "technique", None, None, None, None), (5, "op", "technique", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "line_no long, id string, arm string, technique string, style string, language string, prompt string")
    got = {r["line_no"]: tuple(r)[1:] for r in splits.design_cells(df, TECHNIQUES).collect()}
    assert got[1] == ("product_counting", "terse", "en", False) and got[2] == ("product_counting", "terse", "en", True) and 3 not in got
    assert got[4][:3] == (None, None, None)
    parts = {r["line_no"]: r["split"] for r in splits.keep_cells_together(df, TECHNIQUES, [("train", 0.5), ("test", 0.5)]).collect()}
    assert parts[1] == parts[2] and parts[4] == parts[5] and len(parts) == 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.sampled_from([None, 2, 6, 1000]))
def test_pack_respects_capacity(lengths, small):
    where = packing.pack(lengths, 100, small)
    load = defaultdict(int)
    for n, b in zip(lengths, where):
        load[b] += n
    assert all(0 < v <= 100 for v in load.values()) and set(load) == set(range(len(load)))
    if lengths and small is None:
        assert len(load) <= 1.7 * -(-sum(lengths) // 100) + 1


def test_pack_is_tight():
    rng = random.Random(4)
    lengths = [min(2048, max(1, int(rng.lognormvariate(6, 0.7)))) for _ in range(4000)]
    assert -(-sum(lengths) // 2048) / (max(packing.pack(lengths, 2048)) + 1) > 0.97


def test_containers(spark):
    rows = [(1, "one two three", "x"), (2, "word " * 100, "x"), (3, None, "x"), (4, "", "x"), (1, "one two three", "x"), (None, "four", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    got = packing.fill_containers(df, 16).collect()
    enc = packing.encoder()
    assert sum(r["tokens"] for r in got) == sum(len(enc.encode_ordinary(t)) for _, t, _ in rows if t)
    load = defaultdict(int)
    for r in got:
        load[r["container"]] += r["tokens"]
        assert r["first_token"] == r["piece_no"] * 16
    assert max(load.values()) <= 16
    long = sorted(r["piece_no"] for r in got if r["doc_id"] == 2)
    assert long == list(range(len(long))) and {r["doc_id"] for r in got} == {1, 2, None}
    assert packing.fill_containers(df.limit(0), 16).count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(df, 0)
