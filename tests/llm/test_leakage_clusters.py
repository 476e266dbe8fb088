import itertools
import random
from collections import defaultdict

from corpusloom.llm import clusters, fold, leakage, segment

WORDS = "sieve list prime divisor product remainder bound exponent factor tree chain index set sum class pair core block root side".split()


def sentence(rng):
    return f"{rng.choice(WORDS).title()} {rng.choice(WORDS)} {rng.randint(100, 999)} meets the {rng.choice(WORDS)} of $n^{{{rng.randint(2, 29)}}} - {rng.randint(10, 99)}m$ at stage {rng.randint(100, 9999)}."


def change(text, rng):
    words = text.split(" ")
    words[rng.randrange(1, 3)] = "other"
    out = " ".join(words)
    k = rng.randrange(5)
    return [out.upper(), out.replace(" ", "  "), out.replace("$", "").replace("n", "n"), out.replace("n^", "q^").replace("m$", "k$"), "**" + out + "**"][k]


def test_fold():
    assert fold.letters("Ｔhe  *Sieve* é $x^2$!") == fold.letters("the sieve e y^2") == "thesievevv2"
    assert fold.words("k! + 27, 剰余") == ["v", "27", "剰", "余"]


def test_fold_of_many_texts():
    texts = ["a <b and c", "d> x", "é &amp; <i>y</i> 剰余_2", "", "Ｔhe n_3", "<\x1e>".replace("\x1e", " ")]
    assert fold.words_of_each(texts) == [fold.words(t) for t in texts] and fold.words_of_each([]) == []


def test_within_against_table():
    rng = random.Random(1)
    for _ in range(80):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (8, 14))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p):
            new = [i + 1]
            for j, y in enumerate(t):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        best = min(row)
        for e in range(4):
            assert leakage.within(p, t, e) == (best <= e)


def leak_case(seed=3, docs=120):
    rng = random.Random(seed)
    items = [(k, [sentence(rng) for _ in range(5)]) for k in range(20)]
    out, want = [], set()
    for d in range(docs):
        body = [sentence(rng) for _ in range(8)]
        if d % 2 == 0:
            k, s = items[d // 2 % 20]
            take = (5, 4, 3, 1, 2)[d // 2 % 5]
            for x in rng.sample(s, take):
                body.insert(rng.randrange(len(body) + 1), change(x, rng))
            if take >= 3:
                want.add((d, k))
        out.append((d, " ".join(body)))
    return [(k, " ".join(s)) for k, s in items], out, want


def test_leaks_are_found():
    items, docs, want = leak_case()
    index = leakage.build_index(items)
    got = {(docs[a][0], index.item_ids[b]) for a, b, _ in leakage.search(index, [t for _, t in docs])}
    assert got == want


def test_leak_operator(spark, monkeypatch):
    items, docs, want = leak_case(5, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(1000, None, "x"), (1001, "", "x"), (docs[0][0], docs[0][1], "x")], "doc_id long, text string, item_id string")
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 900)  # several blocks
    got = [tuple(r)[:2] for r in leakage.leaked_items(df, [*items, (99, None), (98, "...")]).collect()]
    assert set(got) == want and len(got) == len(want) + 1
    assert leakage.leaked_items(df.limit(0), items).count() == 0
    assert leakage.leaked_items(df, []).count() == 0


def versions(seed=7, families=25, hot=60):
    rng = random.Random(seed)
    shared = [sentence(rng) for _ in range(10)]  # sentences many texts have in common
    rows, family = [], {}
    for f in range(families):
        base = [sentence(rng) for _ in range(7)] + rng.sample(shared, 2)
        for _ in range(hot if f == 0 else rng.randint(1, 6)):
            s = [change(x, rng) if rng.random() < 0.3 else x for x in base]
            if rng.random() < 0.5:
                s.pop(rng.randrange(len(s)))
            family[len(rows)] = f
            rows.append((len(rows), " ".join(s)))
    return rows, family


def recurs(a, b):
    """Written from the definition: one word left out of each (numbers kept), or the same telling numbers and half of the words in order."""
    numbers = [[w for w in x if w.isdigit()] for x in (a, b)]
    rich = [len(n) >= 2 and sum(map(len, n)) >= 4 for n in numbers]
    if numbers[0] != numbers[1] or rich[0] != rich[1]:
        return False
    if rich[0]:
        a, b = ([w for w in x if not w.isdigit()] for x in (a, b))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return 2 * row[-1] >= max(len(a), len(b))
    # equal, or equal after one word of each, or of one, is left out
    left = [{tuple(x)} | ({tuple(x[:k] + x[k + 1 :]) for k in range(len(x)) if not x[k].isdigit()} if len(x) >= 4 else set()) for x in (a, b)]
    return bool(left[0] & left[1])


def joined(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def closure(rows, share=0.5):
    words = {i: {tuple(fold.words(t[a:b])) for a, b in segment.units(t)} - {()} for i, t in rows}
    every = sorted(set().union(*words.values()))
    of = joined([(a, b) for a, b in itertools.combinations(every, 2) if recurs(list(a), list(b))], every)
    keys = {i: {of[w] for w in ws} for i, ws in words.items()}
    root = joined([(a, b) for a, b in itertools.combinations(keys, 2) if keys[a] and keys[b] and len(keys[a] & keys[b]) > share * min(len(keys[a]), len(keys[b]))], keys)
    groups = defaultdict(list)
    for i in keys:
        groups[root[i]].append(i)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


def test_clusters_equal_families(spark):
    rows, family = versions()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "row_idx long, proof string, cluster string")
    members = clusters.cluster_versions(df).cache()
    got = {tuple(r) for r in clusters.cluster_pairs(members).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(family), 2) if family[a] == family[b]}
    assert got == closure(rows)
    assert len(got ^ want) <= 0.02 * len(want)
    labels = spark.createDataFrame([(0, "up"), (1, None)], "row_idx long, direction string")
    shape = clusters.describe_clusters(members, labels).collect()
    assert sum(r["size"] for r in shape) == len(rows) and max(r["size"] for r in shape) == 60
    assert all(1 <= len(r["typical"].split(",")) <= 3 for r in shape)


def test_cluster_edges(spark):
    same = "The sieve 123 meets 456 lists. The bound 777 is 888."
    rows = [(1, same), (2, same), (3, same.upper()), (4, None), (5, ""), (6, "..."), (7, same), (7, same)]
    df = spark.createDataFrame(rows, "row_idx long, proof string")
    members = clusters.cluster_versions(df).cache()
    assert members.count() == len(rows)
    got = {tuple(r) for r in clusters.cluster_pairs(members).collect()}
    assert got == {(a, b) for a, b in itertools.combinations([1, 2, 3, 7], 2)}
    assert clusters.cluster_versions(df.limit(0)).count() == 0


def test_entry_has_the_queries(spark, data_dir):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n[0] == "p" and n[1].isdigit()]
    assert {n.split("_")[0] for n in names} == {f"p{k}" for k in range(1, 9)}
    for name in ("p2_rates", "p3_segments", "p4_found", "p5_splits", "p6_containers", "p7_found", "p8_found"):
        assert e.queries()[name](spark, data_dir).count() > 0, name


def test_hot_keys_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SALT_ROWS", 50, raising=False)
    rng = random.Random(11)
    hot = range(1, 31)
    sets = {k: [*rng.sample(hot, 2), *range(1000 * k, 1000 * k + 4)] for k in range(1, 601)}  # hot keys only in the minority
    for k in range(601, 681, 2):
        shared = rng.sample(hot, 3)
        sets[k], sets[k + 1] = [*shared, 1000 * k, 1000 * k + 1], [*shared, 1000 * k + 2, 1000 * k + 3]
    root = {k: k for k in sets}
    got_root = dict(root)

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    held = {k: set(v) for k, v in sets.items()}
    for a, b in itertools.combinations(sets, 2):
        if 2 * len(held[a] & held[b]) > min(len(held[a]), len(held[b])):
            root[find(root, a)] = find(root, b)
    nodes = spark.createDataFrame(list(sets.items()), "node long, keys array<long>")
    for r in clusters.links(nodes).collect():
        assert 2 * len(held[r.src] & held[r.dst]) > min(len(held[r.src]), len(held[r.dst]))
        got_root[find(got_root, r.src)] = find(got_root, r.dst)
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if find(root, a) == find(root, b)]
    assert len(pairs) >= 40
    assert all(find(got_root, a) == find(got_root, b) for a, b in pairs)


def test_number_poor_sentences_recur_with_one_word_changed(spark):
    base = ["Hence the remainder of every proper divisor lies outside the sieve.", "Finally we may assume that the coprime pair is minimal here.", "对每个数归纳可知更大的数也成立没有更小的解。"]
    worded = ["Hence the residue of every proper divisor lies outside the sieve.", "Finally we may now assume that the coprime pair is minimal here.", "对每个数归纳可知更大的整数也成立没有更小的解。"]
    rich = ["The sieve 123 meets 456 lists.", "The bound 777 is 888."]
    more = ["The sieve 123 meets exactly 456 lists.", "The bound 777 is 888 again."]
    other = ["Hence the order of every small prime lies outside the sieve 7.", "Finally no one may assume that this coprime pair is small here.", "由此可见剩余类的上界决定素因子。"]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((base, worded, other, rich, more))], "row_idx long, proof string")
    got = {tuple(r) for r in clusters.cluster_pairs(clusters.cluster_versions(df)).collect()}
    assert got == {(0, 1), (3, 4)}
    marks = marks_of([fold.words(x) for x in ("The sum is 5 for the pair.", "The sum is 6 for the pair.")])
    assert not marks[0] & marks[1]  # numbers tell sentences apart


def marks_of(wordings):
    owner, mark = clusters.wording_marks(wordings)
    return [set(mark[owner == k].tolist()) for k in range(len(wordings))]


def test_marks_against_brute_force():
    rng = random.Random(9)
    texts = [[rng.choice(["a", "bb", "c", "7", "12"]) for _ in range(rng.randint(1, 7))] for _ in range(150)]
    found = marks_of(texts)
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        if all(len([w for w in x if w.isdigit()]) < 2 for x in (a, b)):
            assert bool(found[i] & found[j]) == recurs(a, b), (a, b)


def test_equal_numbers_alone_do_not_recur(spark):
    a = ["In 1923 they bought 4567 new red bicycles there.", "On 12 may 2004 the harbour froze."]
    b = ["By 1923 our house held 4567 very old books.", "After 12 years some 2004 birds came back."]
    c = ["In 1923 they sold 4567 new blue bicycles there.", "On 12 may 2004 the old harbour froze again."]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((a, b, c))], "row_idx long, proof string")
    assert {tuple(r) for r in clusters.cluster_pairs(clusters.cluster_versions(df)).collect()} == {(0, 2)}


def test_many_wordings_of_the_same_numbers(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ANCHORS", 2)  # several rounds of leaders
    rng = random.Random(2)
    families = [[rng.choice(WORDS) + tail for _ in range(6)] for tail in "abcdefg"]
    rows = []
    for ws in families:
        for _ in range(6):
            v = list(ws)
            v[rng.randrange(6)] = "other"
            rows.append((len(rows), f"{v[0]} {v[1]} 2020 {v[2]} {v[3]} 2021 {v[4]} {v[5]}."))
    got = {tuple(r) for r in clusters.cluster_pairs(clusters.cluster_versions(spark.createDataFrame(rows, "row_idx long, proof string"))).collect()}
    assert got == closure(rows) and len(got) == 7 * 15


def test_hot_sentences_do_not_hide_links(spark):
    rng = random.Random(5)
    hot = [sentence(rng) for _ in range(2)]
    rows = [(k, " ".join([sentence(rng) for _ in range(8)] + hot)) for k in range(200)]
    rows.append((200, " ".join([*hot, sentence(rng)])))  # two of its three sentences recur in all others
    members = {r["row_idx"]: r["cluster"] for r in clusters.cluster_versions(spark.createDataFrame(rows, "row_idx long, proof string")).collect()}
    found = clusters.links(clusters.keyed(spark.createDataFrame(rows, "row_idx long, proof string"), "row_idx", "proof").select("node", "keys"))
    nodes = joined([(r.src, r.dst) for r in found.collect()], [r for r in {x for r in found.collect() for x in (r.src, r.dst)}])
    assert len(nodes) == 201 and len(set(nodes.values())) == 1
    assert sum(c == members[200] for c in members.values()) == 201


def test_leaks_without_an_intact_q_gram():
    items = [(1, "n=12 ok. m=34 no."), (2, "ab."), (3, "The prime 512 divides the chain 77. The bound 901 exceeds the sum 38.")]
    spoilt = "Thx prixe 512 dixides txe chxin 77. Txe boxnd 901 exceexs thx sum 38."
    docs = [spoilt, "x = 12 ok, y = 34 no", "zzab zz", "The prime 513 divides the chain 77. The bound 901 exceeds the sum 39.", ""]
    index = leakage.build_index(items)
    got = {(a, index.item_ids[b]) for a, b, _ in leakage.search(index, docs)}
    assert {(0, 3), (1, 1), (2, 2)} <= got
    assert not {(3, 3), (3, 1), (4, 1)} & got


def test_near_copies_hide_no_leak():
    item = "The divisor chain of 512 meets the sieve at 77 steps and the bound 901 holds."
    near = item.replace("901", "902").replace("77", "78")
    index = leakage.build_index([(1, item)])
    for body in ([item], [item, near], [near, item], [near, near, item, near]):
        found = leakage.search(index, ["Some words before. " + " ".join(body) + " And some behind."])
        assert [(a, b) for a, b, _ in found] == [(0, 0)], body
    assert not leakage.search(index, [near])


def test_leaks_within_the_budget_against_brute_force():
    rng = random.Random(12)
    items, docs = [], []
    for k in range(60):
        text = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(20, 90)))
        items.append((k, text + "."))
        spoilt = list(text)
        step = rng.choice((4, 5, 6, 8))  # substitutions spread evenly leave few q-grams whole
        for at in range(rng.randrange(step), len(spoilt), step):
            spoilt[at] = "z"
        docs.append("".join(rng.choice("abcdefghijklmnop") for _ in range(60)) + "".join(spoilt) + "".join(rng.choice("abcdefghijklmnop") for _ in range(60)))
    index = leakage.build_index(items)
    want = {(d, p) for d, t in enumerate(docs) for p in range(len(index.patterns)) if leakage.within(index.patterns[p], fold.letters(t), int(index.budget[p]))}
    assert {(a, b) for a, b, _ in leakage.search(index, docs)} == want and len(want) >= 55


def test_results_agree_with_sql(spark, data_dir):
    import duckdb

    from corpusloom.llm import queries

    con = duckdb.connect()
    for name in ("primes", "proofs_primes", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        ours = queries.queries()[name](spark, data_dir)
        assert sorted(map(str, (tuple(r) for r in ours.select(sorted(ours.columns)).collect()))) == sorted(str(tuple(r)) for r in con.execute(f"SELECT {', '.join(sorted(ours.columns))} FROM ({sql})").fetchall()), name
