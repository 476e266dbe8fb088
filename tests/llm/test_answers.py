import random

import pytest

from corpusloom.llm import answers, endings, language, records

PROMPT = "Task: show that no finite list holds every prime.\nAny approach will do. Aim: Use nothing but counting.\nWrite everything in French.\nLeave out titles."


@pytest.mark.parametrize(
    "text",
    ["It is so.", "It is so. ∎", "It is so.  ​", "It is so. //", "It is so. <br>", 'It is so."}', "Ende gut. w.z.b.w.", "C'est fini. CQFD", "完了。（証明終わり）", "完。证毕", "We are done.\n$$ x + 1 $$", "Is it so?", "That settles eq. (3).[3]", "(This is Thm. 2.)", "“It is so.”", "Lücken usw.", "We list gaps, etc.", "outside block 150.", "roughly 1.896 (cf. Lemma 2).", "Der Wert „ist so.“ □"],
)
def test_whole_endings(text):
    assert endings.ending(text)[0] != endings.CUT


@pytest.mark.parametrize(
    "text",
    ["It is s", "It is so, and", "It is so. Then the…", "It is so. On [cut]", "It is. Then x&he", "It is. Then <br", 'It is. Then"}', "The density is high (cf. Prop. 3.", "It is minimal, i.e.", "que ceci, c.-à-d.", "Nach dem 38.", "It is. We write $x +", "$$ a + b", "これは数", "It is. We obtain\n$$ x $$", "so that n!", "この数は。�", "mit (x + 80)"],
)
def test_cut_endings(text):
    assert endings.ending(text)[0] == endings.CUT


def test_decimals_are_learnt_from_all_texts(spark):
    rows = [(k, PROMPT, f"The bound is roughly {k % 9}.{k}25 here. It holds outside block {k % 9}. So it ends.", "b", "x") for k in range(40)]
    rows += [(100, PROMPT, "The bound is roughly 4.", "b", "x"), (101, PROMPT, "It holds outside block 4.", "b", "x"), (102, PROMPT, "At the very least 7.", "b", "x"), (103, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers.decimal_contexts(df, "proof") == {"is roughly"} and answers.decimal_contexts(df.limit(0), "proof") == frozenset()
    assert {r["line_no"] for r in answers.truncation(df).where("truncated").collect()} == {100}


# Not looked at when the templates were written: how else one may decline.
HELD_OUT = """I'm afraid this request falls outside my remit.
That isn't something I do.
Unfortunately I am not in a position to supply such a text.
I will have to pass on this one.
Regrettably, I'm unable to comply with what you ask.
I don't think I should write this; I must say no.
This goes beyond what I have been asked to handle, so I won't write it.
I'd prefer not to provide a proof of that statement, number 3 on your list.
I'm sorry, but I cannot help with proof number 3.
My rules do not let me answer questions of this type.
Je regrette, mais cela dépasse mes attributions.
Malheureusement, je ne suis pas habilité à rédiger ce texte.
Il ne m'est hélas pas possible de satisfaire votre demande.
Je me vois contraint de décliner.
Mes règles m'interdisent de traiter ce sujet.
Das liegt leider außerhalb meiner Möglichkeiten.
Ich sehe mich außerstande, diesen Beweis zu liefern.
Dabei kann ich Ihnen leider nicht behilflich sein.
Diese Bitte muss ich zurückweisen, denn ich darf so etwas nicht schreiben.
Ich möchte darauf lieber nicht antworten.
Me temo que esto queda fuera de mi alcance.
Lamento decirle que no voy a redactar ese texto.
No estoy autorizado para contestar a eso.
Prefiero no responder a esta pregunta.
Mi dispiace, ma non posso scrivere questa dimostrazione.
很抱歉，这超出了我的能力范围。
对不起，我不能为您撰写这样的证明。
恐怕我没办法回答这个问题。
恕我无法照办。
申し訳ございませんが、そのご要望には応じられません。
残念ながら、このような文章を書くことは私にはできないのです。
恐れ入りますが、回答を差し控えさせていただきます。""".splitlines()


def test_refusals_of_other_wording_and_any_length():
    n = records.nature
    found = [n(x, PROMPT) == "refusal" for x in HELD_OUT]
    assert sum(found) >= 0.9 * len(HELD_OUT), [x for x, f in zip(HELD_OUT, found) if not f]
    long = "I cannot do this. " + "The topic you raise matters to many people, and I understand why you would like to read more about it. " * 14
    assert len(long) > 1400 and n(long, PROMPT) == "refusal"
    assert n("Let p = 3. Then I cannot divide 7 by 2, so p^2 = 9 is odd. " * 3, PROMPT) == "content"


def test_copies_and_placeholders_of_any_length():
    assert records.nature(" ".join([PROMPT] * 9), PROMPT) == "copied"
    assert records.nature("N/A, n/a; " * 30, PROMPT) == "content" and records.nature("None. " * 40, PROMPT) == "empty"
    assert records.nature("-" * 500, PROMPT) == "empty" and records.nature("nonetheless it holds " * 10, PROMPT) == "content"


def test_limits_beside_block_edges_and_debris(spark):
    rng = random.Random(8)
    out = []
    for k in range(600):
        text = f"Put k = {k}. " + " ".join(rng.choice(["the", "prime", "sieve", "list", "sum"]) for _ in range(900))
        out.append((k, PROMPT, (text[:4096] if k % 3 == 0 else text[: rng.randint(300, 4000)] + ".") + (" ..." if k % 6 == 0 else ""), "b1", "x"))
    text = 'He "said" so & then "went" on. ' * 40
    for k in range(600, 640):  # a limit on the escaped form: the texts themselves differ in length
        t = "ab" * (k - 600) + text
        while answers.encoded_lengths(t)[3] > 1500:
            t = t[:-1]
        out.append((k, PROMPT, t.rstrip(), "b2", "x"))
    df = spark.createDataFrame(out, SCHEMA)
    limits = {(r["source"], r["encoding"], r["length"]) for r in answers.storage_limits(answers.assess(df, "line_no", "proof", "prompt", "batch_id")).collect()}
    assert ("b1", 0, 4096) in limits and any(s == "b2" and e == 3 and 1490 <= n <= 1500 for s, e, n in limits)


def test_natures():
    n = records.nature
    assert [n(x, PROMPT) for x in (None, "", " ​", "N/A", "[]", "<empty>\n", "...")] == ["empty"] * 7
    copies = [PROMPT, PROMPT.lower(), f"“{PROMPT}”", f"Prompt: {PROMPT}", PROMPT + "\n\n" + PROMPT, PROMPT[: int(len(PROMPT) * 0.6)], " ".join(w for k, w in enumerate(PROMPT.split()) if k % 6)]
    assert [n(x, PROMPT) for x in copies] == ["copied"] * len(copies)
    refusals = ["I can't help with this task.", "Thank you for this question. I would rather not answer that.", "Je dois décliner cette demande.", "Diesen Text darf ich nicht verfassen.", "No me es posible ofrecer este texto.", "抱歉，我无法完成这个请求。", "申し訳ありませんが、このご依頼にはお応えできません。", "You ask for “3 primes”. It isn't possible for me to answer that."]
    assert [n(x, PROMPT) for x in refusals] == ["refusal"] * len(refusals)
    content = [PROMPT + "\nPut p = 3 and observe that $n! + 1$ has another divisor. " * 4, "I cannot see why p = 2 fails, so $p^2 = 4$ holds.", "抱歉，下面的论证有些长。令p=3，得到$p^2 = 9$。"]
    assert [n(x, PROMPT) for x in content] == ["content"] * len(content)
    assert n("anything", None) == "content"


def test_lcs_against_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert records.lcs_length(a, b) == t[-1][-1]


def test_encoded_lengths():
    got = dict(zip(answers.ENCODINGS, answers.encoded_lengths('a<é"\n🙂')))
    assert got == {"chars": 6, "utf8": 10, "utf16": 7, "html": 6 + 3 + 5, "json": 8, "json_ascii": len('a<\\u00e9\\"\\n\\ud83d\\ude42'), "crlf": 7}


SCHEMA = "line_no long, prompt string, proof string, batch_id string, defect string"


def rows_with_limit(n=400):
    rng = random.Random(1)
    out = []
    for k in range(n):
        words = " ".join(rng.choice(["the", "prime", "sieve", "list", "divides", "sum", "é"]) for _ in range(rng.randint(20, 120)))
        text = f"Put k = {k}. {words}."
        if k % 4 == 0:
            text = text.encode()[:200].decode(errors="ignore")
        out.append((k, PROMPT, text, None if k % 3 else "b1", "x"))
    return out


def test_hidden_limit_is_found(spark):
    df = spark.createDataFrame(rows_with_limit(), SCHEMA)
    got = {r["source"]: r for r in answers.truncation_rates(df).collect()}
    assert got[None]["limit_encoding"] == "utf8" and got[None]["limit_length"] == 200
    assert 0.15 < got[None]["rate"] < 0.3
    assert sum(r["records"] for r in got.values()) == 400


def test_defects(spark):
    table = language.fit_filter([(t, c) for c, t in (("fr", "Le produit de la liste est un nombre impair et la somme ne change pas. "), ("en", "The product of the list is an odd number and the sum does not change. "), ("de", "Das Produkt der Liste ist eine ungerade Zahl und die Summe bleibt gleich. ")) for _ in range(4)])
    rows = [
        (1, PROMPT, None, "b", "x"), (2, PROMPT, PROMPT, "b", "x"), (3, PROMPT, "I can't answer that.", "b", "x"), (4, PROMPT, "The product of the list is an odd number. The sum does not change and", "b", "x"),
        (5, PROMPT, "Le produit de la liste est un nombre impair. La somme ne change pas.", None, "x"), (5, PROMPT, "Le produit de la liste est un nombre impair. La somme ne", None, "x"), (None, None, "The sum of the list is odd.", "b", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in answers.defective_pairs(df, table).collect()), key=str)
    assert got == sorted([(1, "empty"), (2, "copied"), (3, "refusal"), (4, "truncated"), (4, "other_language"), (5, "truncated")], key=str)
    assert answers.defective_pairs(df.limit(0), table).count() == 0
    assert answers.truncation(df.limit(0)).count() == 0
