"""Vocabulary: TF-IDF, masking, registries of named results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import starts_word

PLACEHOLDER = "⟨m⟩"
#: Terms per language sent along as one array; a dictionary of fixed size.
MAX_TERMS = 10_000


def word_tokens(text: Column | str) -> Column:
    """Maximal runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\p{L}\p{M}\p{N}_]{2,})"), 1)


def word_terms(text: Column | str, longest: int = 1) -> Column:
    """Word n-grams of 1 to `longest` adjacent tokens, joined by a blank."""
    tokens = word_tokens(text)
    out = acc = tokens
    for n in range(2, longest + 1):
        # zipped with its own shift: the tokens are taken once, not once per term
        rest = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        acc = F.zip_with(F.slice(acc, F.lit(1), rest), F.slice(tokens, F.lit(n), rest), lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, acc)
    return out


def _single_blanks(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def char_terms(text: Column | str, shortest: int, longest: int) -> Column:
    """Character n-grams inside words padded by a blank; a padded word shorter than n counts once."""
    words = F.filter(F.split(_single_blanks(text), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        sizes = F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.least(F.lit(longest), F.length(w))))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(padded, grams))


def tfidf(df: DataFrame, id_col: str, terms: Column, min_df: int = 2, fit: Column | None = None) -> DataFrame:
    """Id, term, weight: tf * (ln((1 + N) / (1 + df)) + 1), vectors of length one.

    The vocabulary and N come from the rows where `fit` holds (all by default);
    terms in fewer than `min_df` of them are dropped. Term counts are
    aggregated per row before anything is shuffled; a frequent term costs one
    partial count per partition.
    """
    fit = F.lit(True) if fit is None else fit
    rows = df.select(id_col, fit.alias("_fit"), F.explode(terms).alias("term"))
    tf = rows.groupBy(id_col, "_fit", "term").agg(F.count("*").alias("tf"))
    n = df.where(fit).agg(F.count("*").alias("n"))
    vocabulary = tf.where("_fit").groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    idf = vocabulary.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, id_col).select(id_col, "term", (F.col("w") / F.col("len")).alias("weight"))


#: Characters of text in a part of the documents, characters of words and n-grams of texts taken at once; they bound a worker's memory.
PART_CHARS, WORD_CHARS, BLOCK_GRAMS = 24_000_000, 300_000, 500_000


def _number_grams(words: list[str], shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The n-grams of `char_terms`, word by word: how many a word has, their places in the list of terms, that list.

    An n-gram is numbered by the number of its first n - 1 characters and its last character.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join([f" {w} " for w in words])
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    short = np.flatnonzero(sizes < shortest)
    owners, numbers, terms = [short], [np.arange(len(short))], [f" {words[k]} " for k in short.tolist()]
    head = np.zeros(len(chars), np.int64)
    for n in range(1, longest + 1):
        at = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
        code = pa.array(head[at] << 21 | chars[at + n - 1]).dictionary_encode().indices.to_numpy()
        head[at] = code
        if n >= shortest and len(at):
            first = np.empty(code.max() + 1, np.int64)
            first[code] = at
            owners.append(owner[at])
            numbers.append(code + len(terms))
            terms += [text[i : i + n] for i in first.tolist()]
    owners = np.concatenate(owners)
    return np.bincount(owners, minlength=len(words)), np.concatenate(numbers)[np.argsort(owners, kind="stable")], terms


def _word_grams(words: list[str], shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As `_number_grams`, some words at a time; the n-grams of word k begin at its place in the first array."""
    places: dict[str, int] = {}
    many, numbers = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORD_CHARS, "right")))
        m, local, terms = _number_grams(words[a:b], shortest, longest)
        many.append(m)
        numbers.append(np.fromiter((places.setdefault(t, len(places)) for t in terms), np.int32, len(terms))[local])
        a = b
    return np.cumsum(np.concatenate(many)), np.concatenate(numbers), list(places)


def _gram_counts(rows: pa.Table, shortest: int, longest: int) -> tuple[list[str], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The terms of the texts (id, text), and block by block document, place of the term and count. Rows of one id are one document."""
    ids = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    split = pc.split_pattern(rows.column(1).combine_chunks(), " ")
    coded = split.flatten().dictionary_encode()
    document, word = np.repeat(ids, pc.list_value_length(split).to_numpy()), coded.indices.to_numpy()
    words = coded.dictionary.to_pylist()
    del split, coded
    if "" in words:
        # what an empty text is split into
        held = word != words.index("")
        document, word = document[held], word[held]
    if len(ids) and (np.diff(ids) < 0).any():
        order = np.argsort(document, kind="stable")
        document, word = document[order], word[order]
    starts, numbers, terms = _word_grams(words, shortest, longest)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        total = np.cumsum(starts[word + 1] - starts[word])
        ends = np.append(np.flatnonzero(np.diff(document)) + 1, len(document))
        a = 0
        while a < len(document):
            done = total[a - 1] if a else 0
            # whole documents, one at least
            b = ends[max(np.searchsorted(total[ends - 1], done + BLOCK_GRAMS, "right") - 1, np.searchsorted(ends, a, "right"))]
            w = word[a:b]
            many = starts[w + 1] - starts[w]
            each = np.arange(many.sum()) + np.repeat(starts[w] - (total[a:b] - many - done), many)
            inside = document[a:b].astype(np.int64) - document[a]
            # short keys sort three times as fast
            kind = np.uint32 if (inside[-1] + 1) * len(terms) < 2**32 else np.int64
            keys = np.repeat((inside * len(terms)).astype(kind), many)
            keys += numbers[each].astype(kind)
            keys.sort()
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            d, t = np.divmod(keys[at].astype(np.int64), len(terms))
            yield d + document[a], t, np.diff(at, append=len(keys))
            a = b

    return terms, blocks()


def char_term_report(df: DataFrame, id_col: str, text: str, shortest: int, longest: int, min_df: int = 2) -> DataFrame:
    """L25 per term: docs, weight (sum), most (greatest) of the TF-IDF vectors of all character n-grams, as `tfidf` of `char_terms` has them.

    No row for a document and a term is shuffled: documents are parted by a
    hash of the id, once; each part counts its n-grams, learns how many
    documents have them in all parts, and sends one row for each of its terms.
    """
    n, chars = df.agg(F.count("*"), F.sum(F.length(text))).first()
    parts = max(1, -(-(chars or 0) // PART_CHARS))
    docs = df.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("part"), F.col(id_col).alias("id"), F.coalesce(_single_blanks(text), F.lit("")).alias("t"))

    def count(rows: pa.Table) -> pa.Table:
        terms, blocks = _gram_counts(rows.select(["id", "t"]), shortest, longest)
        k = np.zeros(len(terms), np.int64)
        for _, term, _ in blocks:
            k += np.bincount(term, minlength=len(terms))
        at = np.flatnonzero(k)
        return pa.table({"part": np.full(len(at), rows.column("part")[0].as_py()), "term": pa.array(terms, pa.string()).take(pa.array(at)), "k": k[at]})

    def weigh(rows: pa.Table, vocabulary: pa.Table) -> pa.Table:
        terms, blocks = _gram_counts(rows.select(["id", "t"]), shortest, longest)
        known = pc.index_in(pa.array(terms, pa.string()), value_set=vocabulary.column("term").combine_chunks()).fill_null(-1).to_numpy()
        idf = np.append(vocabulary.column("idf").to_numpy(), 0.0)[known]
        k, weight, most = np.zeros(len(terms), np.int64), np.zeros(len(terms)), np.zeros(len(terms))
        for document, term, tf in blocks:
            held = known[term] >= 0
            document, term, w = document[held], term[held], tf[held] * idf[term[held]]
            squares = np.bincount(document - document[:1], weights=w * w) if len(document) else w
            w /= np.sqrt(squares)[document - document[:1]]
            k += np.bincount(term, minlength=len(terms))
            weight += np.bincount(term, weights=w, minlength=len(terms))
            np.maximum.at(most, term, w)
        at = np.flatnonzero(k)
        return pa.table({"term": pa.array(terms, pa.string()).take(pa.array(at)), "docs": k[at], "weight": weight[at], "most": most[at]})

    counted = docs.groupBy("part").applyInArrow(count, "part long, term string, k long")
    df_all = counted.withColumn("df", F.sum("k").over(Window.partitionBy("term"))).where(F.col("df") >= min_df)
    vocabulary = df_all.select("part", "term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = docs.groupBy("part").cogroup(vocabulary.groupBy("part")).applyInArrow(weigh, "term string, docs long, weight double, most double")
    return weighed.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("weight").alias("weight"), F.max("most").alias("most"))


_WORD = re.compile(r"\w+")
_SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|/-])")
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


def _layers(terms: list[str]) -> list[list[str]]:
    """Runs of terms, in the given order, of which no two can overlap in a text.

    Whole tokens overlap only where terms share a token, or where a term meets
    the placeholder of one before it; such a term begins a new run.
    """
    runs: list[list[str]] = []
    seen: set[str] = set()
    for t in terms:
        tokens = {x.lower() for x in _WORD.findall(t)}
        edge = not tokens or not (_WORD.match(t[0]) and _WORD.match(t[-1]))
        if not runs or edge or tokens & seen or tokens & {x.lower() for x in _WORD.findall(PLACEHOLDER)}:
            runs.append([])
            seen = set()
        runs[-1].append(t)
        seen |= tokens if not edge else {x.lower() for u in terms for x in _WORD.findall(u)}
    return runs


def mask(text: Column | str, terms: list[str], spaced: bool) -> Column:
    """The terms replaced one after the other, in the given order.

    Spaced scripts need a word boundary on both sides and ignore case; others
    replace bare substrings. Terms that cannot overlap are replaced in one pass,
    which gives what the sequence gives. Null stays null.
    """
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    out = F.col(text) if isinstance(text, str) else text
    terms = [t for t in terms if t]
    if not terms:
        return out
    if not spaced:
        return F.aggregate(F.array(*map(F.lit, terms)), out, lambda acc, t: F.replace(acc, t, F.lit(PLACEHOLDER)))
    for run in _layers(terms):
        pattern = "|".join(_SPECIAL.sub(r"\\\1", t) for t in run)
        out = F.regexp_replace(out, rf"(?iu){_NOT_AFTER}(?:{pattern}){_NOT_BEFORE}", PLACEHOLDER)
    return out


def mask_by_language(df: DataFrame, terms: dict[str, list[str]], dense: tuple[str, ...], text: str = "proof", name: str = "masked") -> DataFrame:
    """Each row masked with its language's terms; languages without terms stay as they are."""
    out = F.col(text)
    for lang, ts in sorted(terms.items()):
        out = F.when(F.col("language") == lang, mask(text, ts, lang not in dense)).otherwise(out)
    return df.withColumn(name, out)


def leak_check(df: DataFrame, keys: list[str], masked: str = "masked") -> DataFrame:
    """Placeholders per text, their mean, their share of the characters."""
    count = (F.length(masked) - F.length(F.replace(masked, F.lit(PLACEHOLDER), F.lit("")))) / len(PLACEHOLDER)
    return df.where(F.col(masked).isNotNull()).groupBy(*keys).agg(F.sum(count).cast("long").alias("placeholders"), F.avg(count).alias("mean_count"), (F.sum(count * len(PLACEHOLDER)) / F.sum(F.length(masked))).alias("density"))


#: Entries a registry may have; it goes to every worker.
MAX_ENTRIES = 5_000


def registry_rows(registry: DataFrame) -> list[tuple[str, list[str]]]:
    """(name, forms) of a registry in order of name; refused above MAX_ENTRIES."""
    rows = registry.select("name", "forms").orderBy("name").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} registry entries")
    return [(r["name"], [f for f in r["forms"] or [] if f and f != "re:"]) for r in rows]


def form_finder(entries: list[tuple[str, list[str]]]) -> Callable[[str], dict[int, tuple[int, int]]]:
    """A function text -> {entry number: first place and length of its form}.

    All plain forms are found by one automaton in one pass over the text, however
    many there are; where that library is missing, form by form. Patterns ('re:')
    need a word boundary before them and ignore case. Of forms at one place the
    longest counts.
    """
    plain = {}
    for k, (_, forms) in enumerate(entries):
        for f in forms:
            if not f.startswith("re:"):
                plain.setdefault(f, []).append(k)
    patterns = [(k, re.compile("|".join(rf"\b(?:{f[3:]})" for f in forms if f.startswith("re:")), re.I)) for k, (_, forms) in enumerate(entries) if any(f.startswith("re:") for f in forms)]
    try:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for f, ks in plain.items():
            machine.add_word(f, (len(f), ks))
        if plain:
            machine.make_automaton()
    except ImportError:
        machine = None

    def places(text: str) -> Iterator[tuple[int, int, list[int]]]:
        if machine is not None:
            if plain:
                for end, (size, ks) in machine.iter(text):
                    yield end + 1 - size, size, ks
        else:
            for f, ks in plain.items():
                at = text.find(f)
                if at >= 0:
                    yield at, len(f), ks

    def find(text: str) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        for at, size, ks in places(text):
            for k in ks:
                if k not in out or (at, -size) < (out[k][0], -out[k][1]):
                    out[k] = at, size
        for k, pattern in patterns:
            if (m := pattern.search(text)) and (k not in out or (m.start(), m.start() - m.end()) < (out[k][0], -out[k][1])):
                out[k] = m.start(), m.end() - m.start()
        return out

    return find


def registry_hits(df: DataFrame, registry: DataFrame, keep: list[str], text: str = "proof", around: int = 20) -> DataFrame:
    """Keep, name, excerpt: each entry whose forms occur in the text, with `around` characters on both sides of the first place.

    Forms after 're:' are patterns with a leading word boundary, case ignored;
    others are case-sensitive substrings. The registry is a dimension of at
    most MAX_ENTRIES entries (checked); texts are read once, in Arrow batches.
    """
    entries = registry_rows(registry)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("name", T.StringType()), T.StructField("excerpt", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = form_finder(entries)
        for batch in batches:
            rows, names, excerpts = [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                for k, (at, size) in sorted(find(t).items()) if t else ():
                    rows.append(i)
                    names.append(entries[k][0])
                    excerpts.append(t[max(0, at - around) : at + size + around])
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[: len(keep)]), pa.array(names, pa.string()), pa.array(excerpts, pa.string())], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def invoked_counts(df: DataFrame, registry: DataFrame, keep: list[str], text: str = "proof") -> DataFrame:
    """Keep, invoked: distinct registry entries in the text, 0 for null texts. One narrow pass."""
    entries = registry_rows(registry)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("invoked", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = form_finder(entries)
        for batch in batches:
            counts = [len({entries[k][0] for k in find(t)}) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def two_coordinates(counts: DataFrame, reference: str) -> DataFrame:
    """Per direction, and for one reference technique, mean z and mean invoked."""
    d = counts.where("arm = 'extreme' and direction is not null").groupBy(F.col("direction").alias("point"))
    r = counts.where((F.col("arm") == "technique") & (F.col("technique") == reference)).groupBy(F.concat(F.lit("technique: "), "technique").alias("point"))
    agg = (F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.avg("invoked").alias("mean_invoked"))
    return d.agg(*agg).unionByName(r.agg(*agg))


def best_threshold(counts: DataFrame, positive: Column) -> DataFrame:
    """D3: threshold on the invoked count that separates the positive rows best, with its accuracy.

    Works on the histogram of counts; of equal accuracies the smallest threshold wins.
    """
    from pyspark.sql import Window

    h = counts.groupBy("invoked").agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    before = Window.orderBy("invoked").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    right = F.coalesce(F.sum("q").over(before), F.lit(0)) + F.sum("p").over(whole) - F.coalesce(F.sum("p").over(before), F.lit(0))
    scored = h.select("invoked", (right / (F.sum("p").over(whole) + F.sum("q").over(whole))).alias("accuracy"))
    return scored.agg(F.max(F.struct(F.round("accuracy", 9).alias("accuracy"), (-F.col("invoked")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def length_matched(counts: DataFrame, longest: int = 30) -> DataFrame:
    """Mean invoked of the longest technique-arm rows against the extreme arm."""
    t = counts.where("arm = 'technique'").orderBy(F.desc("chars"), "line_no").limit(longest).agg(F.count("*").alias("n"), F.avg("invoked").alias("mean_invoked"), F.avg("chars").alias("mean_chars")).withColumn("rows", F.lit("longest technique"))
    x = counts.where("arm = 'extreme'").agg(F.count("*").alias("n"), F.avg("invoked").alias("mean_invoked"), F.avg("chars").alias("mean_chars")).withColumn("rows", F.lit("extreme"))
    return t.unionByName(x)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """N and Spearman's rho with mean ranks for ties.

    Ranks come from the distinct values with their counts, not from a sort of
    all rows in one task: the running sum is over the value histogram.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)

    def ranks(c: str, name: str) -> DataFrame:
        h = rows.groupBy(c).agg(F.count("*").alias("k"))
        before = F.coalesce(F.sum("k").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return h.select(c, (before + (F.col("k") + 1) / 2).alias(name))

    cells = rows.groupBy(a, b).agg(F.count("*").alias("w")).join(ranks(a, "ra"), a).join(ranks(b, "rb"), b)
    n = F.sum("w")
    ma, mb = F.sum(F.col("w") * F.col("ra")) / n, F.sum(F.col("w") * F.col("rb")) / n
    cov = F.sum(F.col("w") * F.col("ra") * F.col("rb")) / n - ma * mb
    va, vb = F.sum(F.col("w") * F.col("ra") * F.col("ra")) / n - ma * ma, F.sum(F.col("w") * F.col("rb") * F.col("rb")) / n - mb * mb
    return cells.agg(n.alias("n"), (cov / F.sqrt(va * vb)).alias("rho"))


def language_spread(counts: DataFrame, dense: tuple[str, ...]) -> DataFrame:
    """Per direction least and greatest language mean of the count, and the dense over other median ratio."""
    is_dense = F.col("language").isin(*dense)
    per = counts.where("direction is not null").groupBy("direction", "language").agg(F.avg("invoked").alias("m"))
    span = per.groupBy("direction").agg(F.min("m").alias("least"), F.max("m").alias("greatest"))
    ratio = counts.where("direction is not null").groupBy("direction").agg(F.median(F.when(is_dense, F.col("invoked"))).alias("d"), F.median(F.when(~is_dense, F.col("invoked"))).alias("o"))
    return span.join(ratio, "direction").select("direction", "least", "greatest", (F.col("d") / F.nullif(F.col("o"), F.lit(0.0))).alias("ratio"))


def one_language_entries(hits: DataFrame) -> DataFrame:
    """Registry entries that fire in one language only, with the number of texts and the excerpt of the first one (least line_no)."""
    return hits.groupBy("name").agg(F.count_distinct("language").alias("k"), F.min("language").alias("language"), F.count("*").alias("texts"), F.min_by("excerpt", "line_no").alias("excerpt")).where("k = 1").drop("k")


# What opens a proof, in six languages; forms after "re:" are patterns.
PROOF_MARKERS = [
    r"re:proof\b", r"re:Beweis", r"re:Preuve", r"re:D[ée]monstration",
    r"re:Prueba", r"re:Demostraci[óo]n", "证明", "証明",
]


def proved_markers(markers: list[str] | None = None, text: str = "proof") -> Column:
    """Whether a text carries a proof marker, so that results cited in it may be proved too."""
    found = F.lit(False)
    for m in PROOF_MARKERS if markers is None else markers:
        found = found | (F.col(text).rlike(starts_word(m[3:], literal=False)) if m.startswith("re:") else F.contains(text, F.lit(m)))
    return found


def cited_not_proved(counts: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """D11 in counts: per key texts, mean results invoked, and their mean in texts without a proof marker."""
    marked = texts.select("line_no", F.coalesce(proved_markers(), F.lit(False)).alias("marked"))
    return counts.join(marked, "line_no").groupBy(*keys).agg(
        F.count("*").alias("texts"), F.count_if("marked").alias("marked"), F.avg("invoked").alias("mean_invoked"), F.avg(F.when(~F.col("marked"), F.col("invoked"))).alias("mean_cited"), F.sum(F.when(F.col("marked"), F.lit(0)).otherwise(F.col("invoked"))).alias("cited")
    )


# mathematicians' names in Latin, Chinese and Japanese script.
NAMES = [
    ("euclid", [r"re:Euclid\w*", r"re:Euklid\w*", r"re:Eucli?de\w*", "欧几里得", "エウクレイデス", "ユークリッド"]),
    ("euler", [r"re:Euler\w*", r"re:Eulersch\w*", "欧拉", "オイラー"]),
    ("fermat", [r"re:Fermat\w*", "费马", "フェルマー"]),
    ("erdos", [r"re:Erd[őoö]s", "埃尔德什", "厄尔多斯", "エルデシュ", "エルデーシュ"]),
    ("furstenberg", [r"re:F[üu]rstenberg", r"re:Furstenberg", "菲尔斯滕贝格", "フルステンベルグ"]),
    ("mersenne", [r"re:Mersenne\w*", "梅森", "メルセンヌ"]),
    ("riemann", [r"re:Riemann\w*", "黎曼", "リーマン"]),
    ("dirichlet", [r"re:Dirichlet\w*", "狄利克雷", "ディリクレ"]),
    ("chebyshev", [r"re:Chebyshev", r"re:Tschebysch\w*", r"re:Tchebych\w*", "切比雪夫", "チェビシェフ"]),
    ("bertrand", [r"re:Bertrand", "伯特兰", "ベルトラン"]),
    ("legendre", [r"re:Legendre", "勒让德", "ルジャンドル"]),
    ("gauss", [r"re:Gauss\w*", r"re:Gau[ßs]\w*", "高斯", "ガウス"]),
    ("bezout", [r"re:B[ée]zout", "裴蜀", "ベズー"]),
    ("zsigmondy", [r"re:Zsigmondy"]),
    ("sylvester", [r"re:Sylvester"]),
    ("kummer", [r"re:Kummer"]),
    ("stieltjes", [r"re:Stieltjes"]),
    ("perott", [r"re:Perott"]),
    ("auric", [r"re:Auric"]),
    ("metrod", [r"re:M[ée]trod"]),
    ("thue", [r"re:Thue"]),
    ("tennenbaum", [r"re:Tennenbaum", "テネンバウム"]),
    ("bashmakova", [r"re:Bashmakova", r"re:Ba[sš]makova"]),
    ("conway", [r"re:Conway", "康威", "コンウェイ"]),
    ("guy", [r"re:Richard Guy", r"re:Conway-?Guy"]),
    ("laczkovich", [r"re:Laczkovich"]),
    ("dedekind", [r"re:Dedekind", "戴德金", "デデキント"]),
    ("eisenstein", [r"re:Eisenstein"]),
    ("gelfond", [r"re:Gelfond", r"re:Gel'?fond"]),
    ("liouville", [r"re:Liouville", "刘维尔", "リウヴィル"]),
    ("pythagoras", [r"re:Pythagor\w*", r"re:pitag[óo]ric\w*", "毕达哥拉斯", "ピタゴラス", "勾股"]),
    ("garfield", [r"re:Garfield", "加菲尔德", "ガーフィールド"]),
    ("ptolemy", [r"re:Ptolem\w*", r"re:Ptolem[äa]\w*", r"re:Ptol[ée]m\w*", "托勒密", "プトレマイオス"]),
    ("de_gua", [r"re:de Gua", r"re:De Gua"]),
    ("cauchy", [r"re:Cauchy", "柯西", "コーシー"]),
    ("schwarz", [r"re:Schwarz\w*", "施瓦茨", "シュワルツ"]),
    ("heron", [r"re:Heron\w*", r"re:H[ée]ron\w*", "海伦", "ヘロン"]),
    ("thales", [r"re:Thales", r"re:Thal[èe]s", r"re:Tales de Mileto", "泰勒斯", "タレス"]),
    ("loomis", [r"re:Loomis"]),
    ("bhaskara", [r"re:Bh[āa]skara", "婆什迦罗", "バースカラ"]),
    ("liu_hui", [r"re:Liu Hui", "刘徽"]),
    ("zhoubi", [r"re:Zhoubi", r"re:Zhou Bi", "周髀"]),
]
# Notation that tells a technique.
NOTATION = [
    ("euler_product_notation", [r"re:\\zeta", "ζ", "∏", r"re:\\prod"]),
    ("fermat_tower", [r"re:2\^\{?2\^", r"re:2\^\(2\^", r"re:F_?\{?n\}?\s*=", "2^(2^n)", "2^{2^n}"]),
    ("factorial_plus_one", [r"re:n!\s*\+\s*1", r"re:N!\s*\+\s*1"]),
    ("euclid_product_plus_one", [r"re:p_?1\s*p_?2\s*\\?cdots?", r"re:\\prod_?\{?i", r"re:p_?1\s*\\cdot"]),
    ("topology_notation", [r"re:N_?\{?a,\s*b\}?", r"re:\\mathcal\{[OT]\}"]),
    ("congruence", [r"re:\\pmod", r"re:\\bmod", r"re:\bmod\b", "≡"]),
    ("radical", [r"re:\\sqrt", "√"]),
]


def mask_forms(text: Column | str, entries: list[tuple[str, list[str]]]) -> Column:
    """Every form of the entries replaced by the placeholder: patterns first, then plain forms, the longer before the shorter.

    Patterns need a word boundary before them and ignore case.
    """
    out = F.col(text) if isinstance(text, str) else text
    forms = sorted({f for _, fs in entries for f in fs if f and f != "re:"}, key=lambda f: (-len(f), f))
    patterns = [f[3:] for f in forms if f.startswith("re:")]
    plain = [f for f in forms if not f.startswith("re:")]
    if patterns:
        out = F.regexp_replace(out, "(?iu)(?U)\\b(?:" + "|".join(patterns) + ")", PLACEHOLDER)
    if plain:
        out = mask(out, plain, spaced=False)
    return out


def tier_masking(df: DataFrame, tiers: dict[str, list[tuple[str, list[str]]]], keys: list[str], text: str = "proof") -> DataFrame:
    """Tier, keys, n, touched (texts with a match), kept (share of the characters): each tier masked alone, the tiers side by side in one pass."""
    masked = F.array(*[F.struct(F.lit(name).alias("tier"), mask_forms(text, entries).alias("masked")) for name, entries in tiers.items()])
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_whole"), F.explode(masked).alias("m"))
    left = F.length(F.replace(F.col("m.masked"), F.lit(PLACEHOLDER), F.lit("")))
    return rows.groupBy(F.col("m.tier").alias("tier"), *keys).agg(F.count("*").alias("n"), F.count_if(F.col("m.masked") != F.col("_whole")).alias("touched"), (F.sum(left) / F.sum(F.length("_whole"))).alias("kept"))
