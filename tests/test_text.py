import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import bookkeeping, encoding, lengths, lexical
from corpusloom.plans import catalog


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, "  　a b\n ", "string", text.strip_all("v")) == "a b"
    assert one(spark, None, "string", text.strip_all("v")) is None
    assert one(spark, "t__tech__en__terse__3", "string", text.id_part("v", 2)) == "tech"
    assert one(spark, "opaque", "string", text.id_part("v", 2)) is None
    assert one(spark, "/a/proofs_x.v2.jsonl", "string", text.cache_name("v")) == "x_v2"
    assert one(spark, "abc", "string", text.short_hash("v")) == "90015098"
    df = spark.createDataFrame([("a {x} b", "1"), (None, "1"), ("{x}", None)], "t string, x string")
    assert [r[0] for r in df.select(text.fill_template("t", x="x")).collect()] == ["a 1 b", None, None]


def test_leading_boundary(spark):
    df = spark.createDataFrame([("the Sieve works",), ("resieve",), ("$\\zeta sieve2",)], "v string")
    assert [r[0] for r in df.select(F.col("v").rlike(text.starts_word("sieve"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(F.col("v").rlike(text.starts_word("a.c"))).collect()] == [False] * 3


def test_masking_is_sequential(spark):
    df = spark.createDataFrame([("zabcd",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(lexical.mask("v", ["abcd", "zab"], spaced=False)).collect()] == ["z⟨m⟩", None, ""]
    w = spark.createDataFrame([("the The other, thé the_x",)], "v string")
    assert w.select(lexical.mask("v", ["the"], spaced=True)).first()[0] == "⟨m⟩ ⟨m⟩ other, thé the_x"
    assert w.select(lexical.mask("v", [], spaced=True)).first()[0].startswith("the")


def brute_tfidf(docs, min_df=2):
    tok = {i: re.findall(r"[^\W]{2,}", t.lower()) for i, t in docs}
    df = Counter(t for ts in tok.values() for t in set(ts))
    out = {}
    for i, ts in tok.items():
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in Counter(ts).items() if df[t] >= min_df}
        n = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, t): x / n for t, x in w.items()}
    return out


def test_tfidf_against_brute_force(spark):
    docs = [(1, "a prime prime divides"), (2, "the prime list"), (3, "the sieve divides the list"), (4, "")]
    df = spark.createDataFrame(docs, "id long, v string")
    got = {(r["id"], r["term"]): r["weight"] for r in lexical.tfidf(df, "id", lexical.word_terms("v")).collect()}
    want = brute_tfidf(docs)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_char_terms(spark):
    got = one(spark, "ab  c", "string", lexical.char_terms("v", 3, 5))
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " c "])
    assert one(spark, "", "string", lexical.char_terms("v", 3, 5)) == []


def brute_char_report(docs, low, high, min_df=2):
    tf = {}
    for i, t in docs:
        for w in t.lower().split():
            p = f" {w} "
            tf.setdefault(i, Counter()).update(p[k : k + n] for n in range(low, max(low, min(high, len(p))) + 1) for k in range(max(1, len(p) - n + 1)))
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for c in tf.values():
        w = {t: k * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, k in c.items() if df[t] >= min_df}
        for t, x in w.items():
            x /= math.sqrt(sum(y * y for y in w.values()))
            n, total, most = out.get(t, (0, 0.0, 0.0))
            out[t] = n + 1, total + x, max(most, x)
    return out


# two rows of one id, ids that are null, no words, signs beyond 16 bits, a word shorter than the least n-gram
ODD_DOCS = [(1, "a prime Prime divides"), (1, "the primes"), (2, "  "), (3, "素数は無限 \U0001d4ab\U0001d4ab素数は"), (None, "prime \U0001d4ab\U0001d4ab素数"), (None, "a divides"), (4, "无限 素数は\u3000无限"), (5, "")]


@pytest.mark.parametrize("low, high", [(3, 5), (2, 4), (1, 1), (5, 6)])
@pytest.mark.parametrize("chars", [10, 10**6])
def test_char_report_against_brute_force(spark, monkeypatch, low, high, chars):
    monkeypatch.setattr(lexical, "PART_CHARS", chars)
    df = spark.createDataFrame(ODD_DOCS, "id long, v string")
    got = {r["term"]: (r["docs"], r["weight"], r["most"]) for r in lexical.char_term_report(df, "id", "v", low, high).collect()}
    want = brute_char_report(ODD_DOCS, low, high)
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in want)
    assert lexical.char_term_report(df.limit(0), "id", "v", low, high).count() == 0


def test_grams_counted_in_blocks(monkeypatch):
    docs = pa.table({"id": [i for i, _ in ODD_DOCS], "t": [" ".join(t.lower().split()) for _, t in ODD_DOCS]})

    def counted():
        terms, blocks = lexical._gram_counts(docs, 2, 4)
        return {(d, terms[t]): n for block in blocks for d, t, n in zip(*(x.tolist() for x in block))}

    whole = counted()
    monkeypatch.setattr(lexical, "WORD_CHARS", 3)
    monkeypatch.setattr(lexical, "BLOCK_GRAMS", 5)
    assert counted() == whole and whole[0, "pr"] == 3


@pytest.mark.parametrize("name, low, high", [("L25_tfidf_chars", 3, 5), ("L25_tfidf_short_chars", 2, 4)])
def test_char_queries_shuffle_no_row_per_document_and_term(spark, tmp_path, name, low, high):
    docs = [(i, " ".join(f"w{i * k * k % 89}x{k % 7}" for k in range(1, 60))) for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        none = jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    before = written()
    rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    moved = sum(n for k, n in written().items() if k not in before)
    want = brute_char_report(docs, low, high)
    assert {r["term"]: r["docs"] for r in rows} == {t: n for t, (n, _, _) in want.items()}
    assert 0 < moved < sum(n for n, _, _ in want.values()) / 4


def test_registry(spark):
    df = spark.createDataFrame([(1, "By Euclid's lemma"), (2, "EUCLID lemma"), (3, None), (4, "preeuclid")], "line_no long, proof string")
    reg = spark.createDataFrame([("e", ["re:euclid", "nothing"]), ("l", ["lemma"]), ("none", None)], "name string, forms array<string>")
    got = {r["line_no"]: r["invoked"] for r in lexical.invoked_counts(df, reg, ["line_no"]).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0}
    hits = {(r["line_no"], r["name"]) for r in lexical.registry_hits(df, reg, ["line_no"]).collect()}
    assert hits == {(1, "e"), (1, "l"), (2, "e"), (2, "l")}
    assert lexical.registry_hits(df, reg.limit(0), ["line_no"]).count() == 0


def test_lengths_edge_cases(spark):
    df = spark.createDataFrame([(1, "technique", "en", 2.0, 5), (2, "technique", "en", 2.0, 5), (3, "scope", "fr", 1.0, 3), (4, "extreme", "en", None, None)], "line_no long, arm string, language string, log_chars double, chars int")
    z = {r["line_no"]: r["z"] for r in lengths.z_scores(df, F.col("arm") != "scope").collect()}
    assert z == {1: None, 2: None, 3: None, 4: None}
    z = {r["line_no"]: r["z"] for r in lengths.z_scores(df, F.col("arm") != "scope", "pop", True).collect()}
    assert z[1] == 0.0 and z[3] is None
    assert lengths.integrity(df.limit(0).withColumns({"id": F.lit(""), "stop_reason": F.lit(""), "proof": F.lit("")})).first()["rows"] == 0
    tie = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", None)], "k string, lvl string")
    assert [tuple(r) for r in lengths.ranked_mode(tie, ["k"], "lvl").collect()] == [("g", "a", 1)]


def test_grid_and_resume(spark):
    f = bookkeeping.factor
    g = bookkeeping.full_grid(spark, f(spark, "technique", ["a", "b"]), f(spark, "direction", ["d"]), f(spark, "language", ["en", "fr"]), f(spark, "style", ["terse", "verbose"]), f(spark, "target", ["centre", "o"]), 2, 1, "own")
    assert g.count() == 2 * 2 * 2 * 2 + 2 * 2 + 2 * 2
    assert {r["theorem"] for r in g.where("arm = 'scope'").collect()} == {"own", "o"}
    done = g.where("arm = 'technique'").select("id")
    assert bookkeeping.pending(g, done).count() == 8
    with pytest.raises(Exception, match="longer than"):
        bookkeeping.guard_ids(spark.createDataFrame([("x" * 65,)], "id string")).collect()


def test_flatten_response(spark):
    df = spark.createDataFrame([([("text", " a "), ("thinking", "no"), ("text", "b\n")],), ([],), (None,)], "c array<struct<type:string,text:string>>")
    assert [r[0] for r in df.select(bookkeeping.flatten_response("c")).collect()] == ["a b", "", None]


def test_embed(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "line_no long, proof string")
    got = {r["line_no"]: r["vec"] for r in encoding.embed(df, encoding.hashed_encoder(8), "line_no").collect()}
    assert got[1] == got[3] and sum(x * x for x in got[1]) == pytest.approx(1.0) and len(got[2]) == 8


def test_spearman_and_threshold(spark):
    df = spark.createDataFrame([(1, 1, True), (2, 2, False), (2, 3, True), (4, 4, True)], "invoked long, chars long, y boolean")
    r = lexical.spearman(df, "invoked", "chars").first()
    assert r["n"] == 4 and r["rho"] == pytest.approx(0.9486832980505138)
    assert lexical.spearman(df.limit(0), "invoked", "chars").first()["n"] is None
    b = lexical.best_threshold(df, F.col("y")).first()
    assert b["accuracy"] == pytest.approx(0.75)


def test_masking_terms_of_several_words_is_sequential(spark):
    import random

    words = ["a", "b", "c", "d", "m", "ab"]
    rng = random.Random(4)
    cases = [(["b c d", "a b"], "a b c d"), (["a b", "b"], "a b b"), (["m", "a m"], "a m b m"), (["a", "m"], "a b m"), (["(a)", "a"], "(a) a")]
    for _ in range(60):
        terms = sorted({" ".join(rng.choices(words, k=rng.choice((1, 1, 2, 3)))) for _ in range(4)}, key=lambda t: (-len(t), t))
        cases.append((terms, " ".join(rng.choices(words + ["B", "x"], k=12))))
    for terms, t in cases:
        want = t
        for x in terms:
            want = re.sub(rf"(?<!\w){re.escape(x)}(?!\w)", lexical.PLACEHOLDER, want, flags=re.I)
        assert spark.range(1).select(lexical.mask(F.lit(t), terms, spaced=True)).first()[0] == want, (terms, t)


def test_registry_tiers_against_brute_force(spark, data_dir):
    from corpusloom.plans import catalog
    from corpusloom.plans.corpus import corpus

    rows = corpus(spark, data_dir).where("proof is not null").select("line_no", "arm", "proof").collect()
    got = {(r.tier, r.arm): r for r in catalog.queries()["D10_tier_masking"](spark, data_dir).collect()}
    for tier, entries in (("names", lexical.NAMES), ("notation", lexical.NOTATION)):
        forms = sorted({f for _, fs in entries for f in fs}, key=lambda f: (-len(f), f))
        rx = re.compile(r"\b(?:" + "|".join(f[3:] for f in forms if f.startswith("re:")) + ")", re.I)

        def masked(t):
            t = rx.sub("\0", t)
            for f in forms:
                if not f.startswith("re:"):
                    t = t.replace(f, "\0")
            return t

        for arm in {r.arm for r in rows}:
            mine = [(r.proof, masked(r.proof)) for r in rows if r.arm == arm]
            assert got[tier, arm].touched == sum(a != b for a, b in mine) and got[tier, arm].n == len(mine)
            assert got[tier, arm].kept == pytest.approx(sum(len(b.replace("\0", "")) for _, b in mine) / sum(len(a) for a, _ in mine), abs=1e-6)


def test_forms_without_the_automaton(monkeypatch):
    import sys

    entries = [("x", ["ab", "abc", "re:q\\w"]), ("y", ["bc"]), ("z", ["absent"])]
    with_library = lexical.form_finder(entries)("xabcd Qz")
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert lexical.form_finder(entries)("xabcd Qz") == with_library == {0: (1, 3), 1: (2, 2)}
    assert lexical.form_finder([])("x") == {}


def test_settings_guard(spark):
    df = spark.createDataFrame([("a", "high"), ("a", "high")], "model string, effort string")
    bookkeeping.guard_settings(df, "a", "high")
    bookkeeping.guard_settings(df.limit(0), "a", "high")
    with pytest.raises(ValueError, match="holds records of"):
        bookkeeping.guard_settings(df, "a", "low")


def test_cell_spread_counts_repeated_lengths(spark):
    import statistics

    cells = {"a": [3, 3, 3, 10, 7], "b": [5], "c": [0, 0]}
    df = spark.createDataFrame([(k, v) for k, vs in cells.items() for v in vs] + [("a", None)], "k string, chars int")
    got = {r["k"]: r for r in lengths.cell_spread(df, ["k"]).collect()}
    assert got["a"]["n"] == 5 and got["a"]["median_chars"] == 3 and got["a"]["cv"] == pytest.approx(statistics.stdev(cells["a"]) / 5.2)
    assert got["b"]["cv"] is None and got["c"]["cv"] is None
