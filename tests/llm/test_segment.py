import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import segment


def cut(text):
    return [text[a:b] for a, b in segment.units(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("The bound is 1.896 (cf. Lemma 2), i.e. small. Next.", ["The bound is 1.896 (cf. Lemma 2), i.e. small.", "Next."]),
        ("See Fig. 3 vs. Sec. 8.9 at 9.30 a.m. on day 4. No. 58 (pp. 58–60) is it.", ["See Fig. 3 vs. Sec. 8.9 at 9.30 a.m. on day 4.", "No. 58 (pp. 58–60) is it."]),
        ("We list sums, gaps, etc. The rest et al. Done.", ["We list sums, gaps, etc.", "The rest et al.", "Done."]),
        ("That settles eq. (7).[7] Wait ... the bound is off.", ["That settles eq. (7).[7]", "Wait ... the bound is off."]),
        ('He notes "A. B." and nothing more. Yes.', ['He notes "A. B." and nothing more.', "Yes."]),
        ('"Is it finite?" was the question. “It is so.” Then on.', ['"Is it finite?" was the question.', "“It is so.”", "Then on."]),
        ("(This is Thm. 20.) We write n! + 8 and stop.", ["(This is Thm. 20.)", "We write n! + 8 and stop."]),
        ("Nach dem 38. Schritt gilt es, d. h. z. B. hier. Am 2. Mai.", ["Nach dem 38. Schritt gilt es, d. h. z. B. hier.", "Am 2. Mai."]),
        ("Impossible ! C.-à-d. que p. ex. ceci. « Oui ? » fut la question.", ["Impossible !", "C.-à-d. que p. ex. ceci.", "« Oui ? » fut la question."]),
        ("¿Divide a n? ¡De ningún modo! Sí.", ["¿Divide a n?", "¡De ningún modo!", "Sí."]),
        ("因此成立。“它有限吗？”是问题。（这就是注2。）下界．", ["因此成立。", "“它有限吗？”是问题。", "（这就是注2。）", "下界．"]),
        ("版本6.7.13给出2.63，参见p. 13。完｡", ["版本6.7.13给出2.63，参见p. 13。", "完｡"]),
        ("逆に成り立つ\nさて偶数である\n「有限か？」というのが問いであった", ["逆に成り立つ", "さて偶数である", "「有限か？」というのが問いであった"]),
        ("因此成立　于是增长　当然不能！", ["因此成立", "于是增长", "当然不能！"]),
        ("सं. 192 में है। क्या यह है? नहीं!", ["सं. 192 में है।", "क्या यह है?", "नहीं!"]),
        ("Step 3: the list\nA line that\nwraps here. More.\n\nThree facts:\n- one;\n- two and\n  more.\n\nEnd.", ["Step 3: the list", "A line that\nwraps here.", "More.", "Three facts:", "- one;", "- two and\n  more.", "End."]),
        ("We obtain\n$$ x. y $$\nfor all.\nNext.", ["We obtain\n$$ x. y $$\nfor all.", "Next."]),
        ("the sum vanishes.we list gaps, etc. the end.", ["the sum vanishes.", "we list gaps, etc.", "the end."]),
    ],
)
def test_cases(text, want):
    assert cut(text) == want


def test_nothing_to_cut():
    assert segment.units(None) == segment.units("") == segment.units(" \n　​") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 .!?。」「\"“”()（\n$:-　éのん数因"), max_size=80))
def test_units_cover_all_but_blanks(text):
    found = segment.units(text)
    at = 0
    for a, b in found:
        assert at <= a < b and not text[at:a].strip(segment._BLANKS) and text[a:b] == text[a:b].strip(segment._BLANKS)
        at = b
    assert not text[at:].strip(segment._BLANKS)


def test_long_text_is_linear():
    import time

    text = "The sum is 3.5 (cf. Lemma 2). " * 20000
    began = time.time()
    assert len(segment.units(text)) == 20000
    assert time.time() - began < 20


def test_lattice_words():
    assert segment.lattice_words("数である")[-1] == "である"
    assert segment.lattice_words("因此素因子")[0] == "因此"


def test_lexicon_is_learnt_from_texts_with_full_stops(spark):
    said = ["この数は素数を割り切る。続いて和を数える。", "和が増大する。続いて積を見ると、数は残る。", "積は、和に対して増大する。続いて篩を使う。"] * 4
    lexicon = segment.learn_lexicon(spark.createDataFrame([(t,) for t in [*said, None, "", "plain text."]], "text string"), "text")
    assert lexicon.leaning("続いて", True) > 2 and lexicon.leaning("増大する", False) > 1 and lexicon.leaning("積は", False) < 0
    # passages without full stops of a text that has some: words decide, both ways
    text = "これは数である。\n\n和が増大する\n続いて積を見る\n\n素数の積は\n和より大きい"
    assert [text[a:b] for a, b in segment.units(text, lexicon)] == ["これは数である。", "和が増大する", "続いて積を見る", "素数の積は\n和より大きい"]
    # a text without any ends its units at gaps
    assert cut("素数の積は\n和より大きい") == ["素数の積は", "和より大きい"]
    beside = "次の式を得る\n$$ x $$\nさて数である\n和は\n$$ y $$\nより大きい"
    assert cut(beside) == ["次の式を得る\n$$ x $$", "さて数である", "和は\n$$ y $$\nより大きい"]
    assert segment.learn_lexicon(spark.createDataFrame([], "text string"), "text").words == segment.GRAMMAR.words


def test_operator(spark):
    df = spark.createDataFrame([(1, "A. B.", "x"), (2, None, "y"), (None, "C", "z"), (1, "A. B.", "w"), (3, "", "")], "doc_id long, text string, end_pos string")
    got = [tuple(r) for r in segment.sentence_units(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 2), (1, 1, 3, 5), (1, 0, 0, 2), (1, 1, 3, 5), (None, 0, 0, 1)], key=str)
    assert segment.sentence_units(df.limit(0)).count() == 0


def test_capitals_behind_the_first_2000_characters_count():
    lower = "the sum of the list is even for every prime. " * 50
    assert len(lower) > 2000
    later = ["We use the sieve etc. and so it goes.", "The bound is even."]
    assert cut(lower + " ".join(later))[-2:] == later
