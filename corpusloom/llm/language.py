"""Language of texts and of the segments of mixed texts, with a confidence.

A bit-sliced Bloom filter holds, for each language, the character n-grams that
are typical of it: slot k of the table is a bitmask of languages, an n-gram
sets its language's bit in a few slots, and a lookup returns the mask of all
languages that contain the n-gram. Per sentence the bits are counted for each
language, the counts are corrected for the filter's false positives, and the
corrected counts decide. Formulas and quotations do not count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from corpusloom.llm import records
from corpusloom.llm.segment import BEFORE_NUMBER, BEFORE_ORDINAL, NEVER_END

#: Labelled rows from which the filter is fitted, at most about this many, and what is read of each; all texts are judged whole.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
SLOT_BITS, HASHES = 18, 3

# Ways to write a language.
LANGUAGE_NAMES = {
    "en": "en eng english englisch anglais inglés ingles 英语 英文 英語 anglisch",
    "fr": "fr fra fre french français francais französisch franzosisch francés frances 法语 法文 フランス語 仏語",
    "de": "de deu ger german deutsch allemand alemán aleman 德语 德文 ドイツ語 独語",
    "es": "es spa spanish español espanol castellano spanisch espagnol 西班牙语 西班牙文 スペイン語 西語",
    "zh": "zh zho chi cn chinese chinesisch chinois chino 中文 汉语 漢語 中国語 华语 普通话 mandarin zh-hans zh-hant",
    "ja": "ja jpn jp japanese japanisch japonais japonés japones 日本語 日语 日文",
    "hi": "hi hin hindi हिन्दी हिंदी 印地语",
    "it": "it ita italian italiano italienisch italien",
    "pt": "pt por portuguese português portugiesisch portugais portugués",
    "ru": "ru rus russian русский russisch russe ruso",
    "ko": "ko kor korean 한국어 koreanisch coréen coreano",
}
_CODES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}
_LONG_WORD = re.compile(r"[a-zÀ-ɏ]{4,}")
_CJK_NAMES = [(n, c) for n, c in _CODES.items() if re.search("[぀-ヿ㐀-鿿]", n)]
_SPELLED = {n: c for n, c in _CODES.items() if len(n) >= 4 and _LONG_WORD.fullmatch(n)}
_DENSE = re.compile("[぀-ヿ㐀-鿿]")


def language_code(label: str | None) -> str | None:
    """The two-letter code a label means; None for null, blank or telling nothing."""
    if label is None:
        return None
    low = unicodedata.normalize("NFC", label).strip().lower()
    return _CODES.get(low) or _CODES.get(re.split(r"[-_. (/]", low, maxsplit=1)[0])


def asked_language(prompt: str | None) -> str | None:
    """The language a prompt asks for: the last one it names, in whatever language."""
    if not prompt:
        return None
    low = prompt.lower()
    code, at = None, -1
    for m in _LONG_WORD.finditer(low):
        if m.group() in _SPELLED:
            code, at = _SPELLED[m.group()], m.start()
    if _DENSE.search(low):
        for name, c in _CJK_NAMES:
            k = low.rfind(name)
            if k > at:
                code, at = c, k
    return code


# --------------------------------------------------------------------------
# the filter

_LUT: np.ndarray | None = None
SPACE = 32
#: No letters are assigned from here on.
LETTERS_END = 0x32400


def _lut() -> np.ndarray:
    """Letters and marks map to themselves, all else to a space."""
    global _LUT
    if _LUT is None:
        table = np.full(LETTERS_END + 1, SPACE, np.uint32)
        for cp in range(LETTERS_END):
            if unicodedata.category(chr(cp))[0] in "LM":
                table[cp] = cp
        _LUT = table
    return _LUT


def _spaceless(c: np.ndarray) -> np.ndarray:
    return ((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x3400) & (c <= 0x9FFF)) | ((c >= 0x20000) & (c < LETTERS_END))


def ngram_keys(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """For each position the 64-bit key of the n-gram centred there (0: none) and its weight.

    Three characters in alphabets; two in scripts without spaces, which weigh
    as three letters.
    """
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _lut()[np.minimum(cp, LETTERS_END)]
    prev = np.empty_like(c)
    prev[0:1], prev[1:] = SPACE, c[:-1]
    nxt = np.empty_like(c)
    nxt[-1:], nxt[:-1] = SPACE, c[1:]
    dense = _spaceless(c)
    prev = np.where(dense, 0, prev).astype(np.uint64)
    key = prev * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + nxt.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    # a single letter between blanks is a variable, not a word
    none = (c == SPACE) | ((prev == SPACE) & (nxt == SPACE) & ~dense)
    key[none] = 0
    return key, np.where(none, 0, np.where(dense, 3, 1)).astype(np.int32)


def _slots(key: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((key >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters of typical n-grams, one bit per language."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    def masks(self, key: np.ndarray) -> np.ndarray:
        a, b, c = _slots(key)
        return self.table[a] & self.table[b] & self.table[c]

    def shares(self, joined: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each span and, per language, its share of typical n-grams, corrected for false positives."""
        key, weight = ngram_keys(joined)
        mask = self.masks(key)
        total = np.concatenate(([0], np.cumsum(weight, dtype=np.int64)))
        size = (total[ends] - total[starts]).astype(float)
        out = np.zeros((len(starts), len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.concatenate(([0], np.cumsum(np.where(mask >> np.uint64(k) & np.uint64(1), weight, 0), dtype=np.int64)))
            out[:, k] = hits[ends] - hits[starts]
        share = out / np.maximum(size, 1)[:, None]
        return size, np.clip((share - self.false_positive) / (1 - self.false_positive), 0, 1)


def fit_filter(samples: list[tuple[str, str]], typical: float = 0.35, least: int = 2) -> LanguageFilter:
    """Fit from (text, language code) rows, some of them labelled wrongly.

    An n-gram is typical of a language when it occurs in at least `least` of
    its sampled texts and at `typical` times the rate of the language where it
    is most frequent, so a few per cent of wrong labels put nothing in.
    """
    languages = sorted({code for _, code in samples})
    if len(languages) > 64:
        raise ValueError("more languages than a slot has bits")
    by = {code: [blank(t) for t, c in samples if c == code] for code in languages}
    counts: dict[int, np.ndarray] = {}
    for k, code in enumerate(languages):
        for text in by[code]:
            key, _ = ngram_keys(text)
            for x in np.unique(key[key != 0]).tolist():
                if x not in counts:
                    counts[x] = np.zeros(len(languages))
                counts[x][k] += 1
    table = np.zeros(1 << SLOT_BITS, np.uint64)
    if counts:
        keys = np.fromiter(counts, np.uint64, len(counts))
        n = np.stack(list(counts.values()))
        rate = n / np.array([max(1, len(by[c])) for c in languages])
        keep = (n >= least) & (rate >= typical * rate.max(axis=1, keepdims=True))
        for k in range(len(languages)):
            for slots in _slots(keys[keep[:, k]]):
                np.bitwise_or.at(table, slots, np.uint64(1 << k))
    fill = np.array([np.count_nonzero(table >> np.uint64(k) & np.uint64(1)) / len(table) for k in range(len(languages))])
    return LanguageFilter(languages, table, fill**HASHES)


def blank(text: str) -> str:
    """Lower case with formulas and quotations blanked, positions kept."""
    low = text.lower()
    return records.blank_spans(low if len(low) == len(text) else text)


def filter_from(df: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> LanguageFilter:
    """Fit on about `sample_rows` labelled rows drawn by a hash of the id."""
    total = max(1, df.count())
    cut = int(min(1.0, sample_rows / total) * (1 << 20))
    drawn = df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < cut)
    rows = drawn.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.substring(text_col, 1, SAMPLE_CHARS), label_col).limit(2 * sample_rows).collect()
    return fit_filter([(text, code) for text, label in rows if (code := language_code(label)) and len(text) > 40])


# --------------------------------------------------------------------------
# sentences of a text, enough for counting

_END = re.compile(r"[。．｡！？।]+|[.!?]+(?=[\s)\]\"'”’»]|$)|\n[ \t]*\n|\n(?=[\s\-*•(\d])")
_WORD = re.compile(r"[^\W\d_]+$")
_CLOSED = tuple(".!?。！？．｡।)）]」』”»\"'")


def plain_sentences(text: str) -> list[tuple[int, int]]:
    out, begin = [], 0
    for m in _END.finditer(text):
        a = m.start()
        if text[a] == "!" and a and text[a - 1].isascii() and text[a - 1].isalpha() and not text[max(0, a - 2) : a - 1].isalpha():
            continue  # a factorial
        if text[a] == "." and m.end() == a + 1:
            if a and text[a - 1].isdigit():
                j = a - 1
                while j >= 0 and text[j].isdigit():
                    j -= 1
                word = _WORD.search(text[max(0, j - 10) : j + 1].rstrip())
                if word and word.group() in BEFORE_ORDINAL:
                    continue
            else:
                word = _WORD.search(text, max(0, a - 8), a)
                if word and (word.group().lower() in NEVER_END or word.group().lower() in BEFORE_NUMBER and text[m.end() : m.end() + 2].strip().isdigit() or len(word.group()) == 1 and text[a - 2 : a - 1] in (".", " ") and word.group() in "dzhbueag"):
                    continue
        out.append((begin, m.end()))
        begin = m.end()
    if text[begin:].strip():
        out.append((begin, len(text)))
    return out


@dataclass
class Spoken:
    """Sentences of one text with their language (None: too little to tell)."""

    spans: list[tuple[int, int]]
    langs: list[str | None]
    confidence: list[float]
    weight: list[float]
    leaning: tuple[str, float] | None = None  # where no sentence is sure: what the whole text leans to

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for x in self.langs:
            if x:
                out[x] += 1
        return out

    def found(self) -> dict[str, float]:
        """Languages with at least two sentences, else the leading one, with confidence."""
        mass: dict[str, float] = defaultdict(float)
        size: dict[str, float] = defaultdict(float)
        for x, c, w in zip(self.langs, self.confidence, self.weight):
            if x:
                mass[x] += c * w
                size[x] += w
        if not size:
            return {self.leaning[0]: self.leaning[1]} if self.leaning else {}
        n = self.counts()
        if self.leaning and max(n.values()) < 2:
            return {self.leaning[0]: self.leaning[1]}
        most = max(size, key=lambda x: (n[x], size[x], x))
        keep = [x for x in sorted(size) if n[x] >= 2] or [most]
        return {x: round(mass[x] / size[x], 4) for x in keep}


def speak(texts: list[str | None], prompts: list[str | None] | None, table: LanguageFilter) -> list[Spoken]:
    """Sentences and their languages for a batch of texts, in vectorised passes of bounded size.

    A prompt repeated at the head of its answer is passed over.
    """
    out: list[Spoken] = []
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= 600_000 or i + 1 == len(texts):
            out += _speak(texts[begin : i + 1], prompts[begin : i + 1] if prompts is not None else None, table)
            begin, size = i + 1, 0
    return out


def _speak(texts: list[str | None], prompts: list[str | None] | None, table: LanguageFilter, least: float = 14, share: float = 0.5, margin: float = 0.12) -> list[Spoken]:
    parts, rows, starts, ends, local, whole = [], [], [], [], [], []
    at = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        t = blank(text)
        head = 0
        if prompts is not None and (p := prompts[i]) and len(text) > 1.5 * len(p) and text.startswith(p):
            head = len(p)
            t = " " * head + t[head:]
        spans = [s for s in plain_sentences(t) if s[1] > head]
        for k, (a, b) in enumerate(spans):
            rows.append(i)
            starts.append(at + a)
            ends.append(at + b)
            local.append((a, b))
            whole.append(k + 1 < len(spans) or k == 0 or t[a:b].rstrip()[-1:] in _CLOSED)
        parts.append(t)
        at += len(t) + 1
    out = [Spoken([], [], [], []) for _ in texts]
    if not rows or not table.languages:
        return out
    size, shares = table.shares("\n".join(parts), np.asarray(starts), np.asarray(ends))
    order = np.argsort(shares, axis=1)
    best = order[:, -1]
    ix = np.arange(len(best))
    top = shares[ix, best]
    second = shares[ix, order[:, -2]] if shares.shape[1] > 1 else np.zeros(len(best))
    # a last piece without a mark is no whole sentence
    sure = (size >= least) & (top >= share) & (top - second >= margin) & np.asarray(whole)
    for i, span, k, ok, c, w in zip(rows, local, best.tolist(), sure.tolist(), (top - second).tolist(), size.tolist()):
        s = out[i]
        s.spans.append(span)
        s.langs.append(table.languages[k] if ok else None)
        s.confidence.append(c if ok else 0.0)
        s.weight.append(w)
    which = np.asarray(rows)
    for i in {i for i, s in enumerate(out) if s.spans and max(s.counts().values(), default=0) < 2}:
        own = which == i
        mass = (shares[own] * size[own, None]).sum(axis=0) / max(size[own].sum(), 1)
        out[i].leaning = _leaning(texts[i], mass, size[own].sum(), table.languages)
    return out


def _leaning(text: str, mass: np.ndarray, size: float, languages: list[str]) -> tuple[str, float] | None:
    """The language of a text whose n-grams are mostly unknown: by script, then by the leading share."""
    bare = records.blank_spans(text)
    kana, han = len(re.findall(r"[぀-ヿ]", bare)), len(re.findall(r"[㐀-鿿]", bare))
    if kana + han >= 4:
        lang = "ja" if kana * 8 > han else "zh"
        return (lang, 0.3) if lang in languages else None
    order = np.argsort(mass)
    top = mass[order[-1]]
    second = mass[order[-2]] if len(mass) > 1 else 0.0
    if size >= 12 and top >= 0.08 and top - second >= 0.02:
        return languages[order[-1]], round(float(top - second), 4)
    return None


def segments_of(text: str, spoken: Spoken) -> list[tuple[int, int, str, float]]:
    """Runs of sentences in one language; sentences too short to tell join their neighbour."""
    out: list[list] = []
    for (a, b), lang, c, w in zip(spoken.spans, spoken.langs, spoken.confidence, spoken.weight):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            continue
        if out and (lang is None or out[-1][2] is None or out[-1][2] == lang):
            last = out[-1]
            last[1], last[2] = b, last[2] or lang
            last[3] += c * w
            last[4] += w if lang else 0
        else:
            out.append([a, b, lang, c * w, w if lang else 0])
    return [(a, b, lang, round(m / max(w, 1e-9), 4)) for a, b, lang, m, w in out if lang]


# --------------------------------------------------------------------------
# operators


def language_segments(df: DataFrame, table: LanguageFilter, id_col: str, text_col: str) -> DataFrame:
    """One row per segment: id, seg_no, start_pos, end_pos, lang, confidence.

    Null, blank and languageless texts give no rows. A narrow map.
    """
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("seg_no", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, found = [], []
            for i, (t, s) in enumerate(zip(texts, speak(texts, None, table))):
                if t:
                    for k, seg in enumerate(segments_of(t, s)):
                        rows.append(i)
                        found.append((k, *seg))
            cols = list(zip(*found)) if found else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], names=schema.names
            )

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def document_languages(df: DataFrame, table: LanguageFilter, id_col: str, text_col: str, label_col: str, prompt_col: str) -> DataFrame:
    """One row per text and language: id, lang_found, confidence, mixed, label_code, label_right.

    Empty answers and copies of the prompt are passed over; a refusal counts by
    the language it is written in. `label_right` tells whether the label, in
    whatever form, means the text's only language. A narrow map.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("lang_found", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("mixed", T.BooleanType()),
            T.StructField("label_code", T.StringType()),
            T.StructField("label_right", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, prompts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            labels = batch.column(2).to_pylist()
            asked = [None if records.is_empty(t) or records.copies_prompt(t, p) else t for t, p in zip(texts, prompts)]
            rows, out = [], []
            for i, s in enumerate(speak(asked, prompts, table)):
                found = s.found()
                code = language_code(labels[i])
                for lang, c in found.items():
                    rows.append(i)
                    out.append((lang, c, len(found) > 1, code, len(found) == 1 and code == lang))
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], names=schema.names
            )

    return df.select(df[id_col], df[text_col].cast("string"), df[label_col].cast("string"), df[prompt_col].cast("string")).mapInArrow(run, schema)
