import random

import pytest

from corpusloom.llm import language as L


def test_codes():
    assert [L.language_code(x) for x in ("EN", "en-GB", "de_DE", "Chinese", "中文", "日本語", "français", "ger", " fr ")] == ["en", "en", "de", "zh", "zh", "ja", "fr", "de", "fr"]
    assert [L.language_code(x) for x in (None, "", "und", "n/a", "??", "unknown")] == [None] * 6
    assert L.asked_language("Task in English.\nWrite everything in French.") == "fr"
    assert [L.asked_language(x) for x in ("Schreibe die ganze Antwort auf Deutsch.", "Escribe todo en español.", "请全部用中文作答。", "すべて日本語で書いてください。", None, "no language")] == ["de", "es", "zh", "ja", None, None]


@pytest.fixture(scope="module")
def split(proofs):
    rows = [(t, c) for t, lab in zip(proofs.proof, proofs.language) if isinstance(t, str) and len(t) > 150 and (c := L.language_code(lab))]
    random.Random(5).shuffle(rows)
    return rows[: len(rows) * 2 // 3], rows[len(rows) * 2 // 3 :]


def test_held_out_accuracy(split):
    train, test = split
    table = L.fit_filter(train)
    assert (table.false_positive < 0.01).all()
    said = [max(s.found(), key=s.found().get, default=None) for s in L.speak([t for t, _ in test], None, table)]
    right = sum(a == b for a, (_, b) in zip(said, test)) / len(test)
    assert right > 0.9  # a few per cent of the labels are wrong


def test_mixed_and_quoted(split):
    table = L.fit_filter(split[0])
    en = "We may assume that the list is minimal. The product and the sum have the same parity. "
    fr = "On peut supposer que la liste est minimale. Le produit et la somme ont la même parité. "
    one, two, quoted = L.speak([en + fr.split(". ")[0] + ".", en + fr, en + "« " + fr + " »"], None, table)
    assert set(one.found()) == {"en"} and set(two.found()) == {"en", "fr"} and set(quoted.found()) == {"en"}
    segs = L.segments_of(en + fr, two)
    assert [s[2] for s in segs] == ["en", "fr"] and segs[0][0] == 0 and segs[1][0] == len(en) and all(0 < s[3] <= 1 for s in segs)


def test_edges(split):
    table = L.fit_filter(split[0])
    assert [s.found() for s in L.speak([None, "", "123 $x$ 456", "ok"], None, table)] == [{}] * 4
    empty = L.fit_filter([])
    assert L.speak(["some words of text."], None, empty)[0].found() == {}


def test_operators(spark, split):
    table = L.fit_filter(split[0])
    en = "We may assume that the list is minimal. The product and the sum have the same parity."
    rows = [(1, en, "EN", "p", "x"), (2, en, "fr", None, "x"), (3, None, None, None, "x"), (4, en, None, None, "x"), (4, en, None, None, "x"), (None, en, "en", None, "x")]
    df = spark.createDataFrame(rows, "line_no long, proof string, language string, prompt string, mixed string")
    got = [tuple(r)[:2] + (r["label_right"],) for r in L.document_languages(df, table, "line_no", "proof", "language", "prompt").collect()]
    assert sorted(got, key=str) == sorted([(1, "en", True), (2, "en", False), (4, "en", False), (4, "en", False), (None, "en", True)], key=str)
    assert L.language_segments(df, table, "line_no", "proof").count() == 5
    assert L.document_languages(df.limit(0), table, "line_no", "proof", "language", "prompt").count() == 0
    assert L.filter_from(df.limit(0), "line_no", "proof", "language").languages == []
