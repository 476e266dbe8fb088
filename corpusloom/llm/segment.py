"""Sentence units of a text in spaced and spaceless scripts.

A text is cut into blocks (blank lines, list items, headings). Inside a block
the spans in which a mark cannot end a sentence (formulas, quotations,
brackets) and the terminator clusters form a lattice of candidate ends; each
candidate is kept or dropped by what stands around it. Chinese and Japanese
texts that write no full stops end their units at gaps (line breaks, wide
blanks). Beside formula lines, and in passages without full stops of texts that
have some, a dictionary word lattice finds the words beside a gap, and how
often these end and open sentences in all texts classifies it; forms of grammar
count from the start.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import stored

CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
FULL_STOPS = re.compile(r"[。．｡]")

# Abbreviations that never end a sentence, with the part before their last dot.
NEVER_END = frozenset(
    """
    cf vgl vs viz resp ca circa approx aprox env ungef i.e e.g d.h z.b u.ä p.ex p.ej c.-à-d c-à-d
    thm thms th prop props lem lemm cor rem fig figs chap eq eqs eqn nr
    núm pp pág págs abb abschn bem kap bsp anm teor bzw sog s.o s.u dr mr mrs prof
    hrsg bd jh mlle sra sr srta सं उदा डॉ पृ
    """.split()
)
# Abbreviations that end a sentence when the next word can open one.
MAY_END = frozenset("etc usw al a.m p.m ff ibid u.a u.s.w z.t o.ä".split())
# Pairs of an abbreviation's first part and the part after a blank.
SPLIT_PARTS = {("d", "h"), ("z", "b"), ("z", "t"), ("u", "a"), ("u", "ä"), ("o", "ä"), ("s", "o"), ("s", "u"), ("p", "ex"), ("p", "ej"), ("i", "e"), ("e", "g"), ("a", "m"), ("p", "m"), ("a", "c"), ("v", "g")}
# Words before a German ordinal ("nach dem 7. Schritt").
BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur beim jeder jede jedes jedem jeden ein eine einem einen dieser diesem diesen".split())
# Abbreviations that stand before a number; elsewhere they are words or names.
BEFORE_NUMBER = frozenset("p s n f v l no nos num art ch cap sec secs ex tab vol pag def st lema satz".split())
# Words that go on after a quotation with its own mark ("..." was the question).
GOES_ON = frozenset(
    """
    was is were and or but said asked says asks wrote writes replied reads ist war und oder aber sagte fragte schrieb lautet steht
    fut est et ou mais dit demande demanda écrit fue es era y o pero dijo preguntó escribió
    """.split()
)

CLOSERS = "\"'”’»›」』）)]】》〉］｝}*_`"
TERMINATORS = ".!?。！？．｡।॥؟…"
_EVENT = re.compile(
    r"""
    (?P<math>\$\$.*?\$\$|\$[^$]{1,400}?\$)
  | (?P<bracket>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|（(?:[^（）]|（[^（）]*）)*）|【[^【】]*】)
  | (?P<quote>“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「(?:[^「」]|「[^「」]*」)*」|『[^『』]*』|"[^"]*"|《[^《》]*》)
  | (?P<dots>\.{3,}|…+)
  | (?P<term>[.!?。！？．｡।॥؟]+(?:[   ][!?]+)?)
  | (?P<spaced>[   ][!?]+)
    """,
    re.X | re.S,
)
_AFTER = re.compile(r"(?:[\"'”’»›」』）)\]】》}*_`]|[   ]»)*(?:\[[\w,;– -]{1,12}\]|[¹²³⁰-⁹†‡]|\^\{?\d+\}?)*")
_MARKER = re.compile(r"[ \t　]*(?:[-*•–‣·]|\(?[0-9]{1,3}[.)]|\([ivxIVX]{1,5}\)|[ivx]{1,5}[.)]|\(?[a-h]\)|[①-⑳]|[（(][0-9一二三四五六七八九十]{1,3}[）)])[ \t　 ]+(?=\S)")
_HEADING = re.compile(
    r"[ \t　]*(?:\#{1,6}[ \t]+\S.*|(?:\*\*|__)[^*_]+(?:\*\*|__)|(?:\#{0,6}[ \t]*)(?:[^\W\d_]+[ \t  ]+\d+|\d+\.[ \t  ]+[^\W\d_]+|第\d+[^\W\d_]|[^\W\d_]{1,4}\d+)[ \t  ]*[:：][ \t ]*\S.{0,90})[ \t]*"
)
_WORD_BEFORE = re.compile(r"[^\W\d_]+(?:[.\-]+[^\W\d_]+)*$")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_BLANKS = " \t\n\r  　​﻿\x0b\x0c\x85  "
_WIDE_GAP = re.compile(r"[　]+|[ \t]*\n\s*")


# --------------------------------------------------------------------------
# spaceless scripts: word lattice around a gap

# Forms of grammar that end a sentence, open one, and let it go on, in Chinese and Japanese.
FINALS = "である でない だろうか だろう でしょう ました ません ます です ない れる せる た だ か よ ね わ 了 吗 呢 吧 啊".split()
OPENERS = "さて 次に 最後に よって したがって さらに また しかし 逆に 実際 特に もし すなわち ゆえに まず そして だから 因此 于是 所以 此外 最后 反之 现在 事实上 特别地 接下来 假设 如果 但是 然而 而且".split()
GO_ON = "が を に は と の で も へ や て し より から ので 和 与 在 为 把 被 对 从 由 是 使得 因为 即 且 而 或".split()
#: Occurrences that a form of grammar counts for beside what the texts show.
SEED = 4
#: Share of a side's contexts that a word must hold to be kept, so a lexicon has at most 4 / WORD_SHARE entries a side.
WORD_SHARE = 1e-4
_LONGEST = 4
_STOP_OR_PAUSE = re.compile(r"[。．｡！？]+|[，、]|\$+")
_BEFORE = re.compile(r"([぀-ヿ㐀-䶿一-鿿]{1,4})[\"'”’»›」』）)\s]*$")
_BEHIND = re.compile(r"[\"'”’»›」』）)\s　]*([぀-ヿ㐀-䶿一-鿿]{1,4})")


class Lexicon:
    """Words of spaceless scripts with how often they stand before and behind a sentence end, and elsewhere.

    `before` and `behind` map a word to (at ends, elsewhere).
    """

    def __init__(self, before: dict[str, tuple[int, int]], behind: dict[str, tuple[int, int]]):
        self.before, self.behind = dict(before), dict(behind)
        for words, table, ends in ((FINALS, self.before, True), (OPENERS, self.behind, True), (GO_ON, self.before, False)):
            for w in words:
                e, o = table.get(w, (0, 0))
                table[w] = (e + SEED, o) if ends else (e, o + SEED)
        self.words = set(self.before) | set(self.behind)

    def leaning(self, word: str, behind: bool) -> float:
        """Log odds of a sentence end beside the word, from its longest part that is known."""
        table = self.behind if behind else self.before
        parts = (word[:k] if behind else word[-k:] for k in range(min(len(word), _LONGEST), 0, -1))
        for part in parts:
            if part in table:
                e, o = table[part]
                return math.log((e + 0.5) / (o + 0.5))
        return 0.0


def gap_counts(text: str) -> Counter:
    """(behind, at an end, word) for the words of one to four characters beside full stops, and beside commas and formulas."""
    out: Counter = Counter()
    for m in _STOP_OR_PAUSE.finditer(text):
        ends = m.group()[0] not in "，、$"
        if left := _BEFORE.search(text, max(0, m.start() - 8), m.start()):
            out.update((False, ends, left.group(1)[k:]) for k in range(len(left.group(1))))
        if right := _BEHIND.match(text, m.end()):
            out.update((True, ends, right.group(1)[:k]) for k in range(1, len(right.group(1)) + 1))
    return out


def learn_lexicon(df: DataFrame, text_col: str, least: int = 5) -> Lexicon:
    """The lexicon of all texts that write full stops: counts per batch, then per word; words under `least` or WORD_SHARE are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text and CJK.search(text):
                    counts.update(gap_counts(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["behind", "ends", "word", "n"])

    rows = df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, "behind boolean, ends boolean, word string, n long")
    table = rows.groupBy("behind", "word").agg(F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("ends"), F.lit(0)).otherwise(F.col("n"))).alias("o"))
    table = stored(table.where(F.col("e") + F.col("o") >= least))
    whole = table.where(F.length("word") == 1).groupBy("behind").agg((F.sum(F.col("e") + F.col("o")) * WORD_SHARE).alias("floor"))
    kept = table.join(F.broadcast(whole), "behind").where(F.col("e") + F.col("o") >= F.col("floor")).select("behind", "word", "e", "o").limit(int(8 / WORD_SHARE)).collect()
    return Lexicon({r["word"]: (r["e"], r["o"]) for r in kept if not r["behind"]}, {r["word"]: (r["e"], r["o"]) for r in kept if r["behind"]})


def _kind(ch: str) -> int:
    o = ord(ch)
    return 1 if 0x3040 <= o <= 0x309F else 2 if 0x30A0 <= o <= 0x30FF else 3 if 0x3400 <= o <= 0x9FFF else 4 if ch.isalnum() else 5


def lattice_words(piece: str, lexicon: Lexicon | None = None) -> list[str]:
    """Cheapest path through the lattice of the lexicon's words and same-script runs."""
    known = (lexicon or GRAMMAR).words
    n = len(piece)
    best = [0.0] + [1e9] * n
    back = [0] * (n + 1)
    for i in range(n):
        if best[i] >= 1e9:
            continue
        for j in range(i + 1, min(n, i + 6) + 1):
            if piece[i:j] in known and best[i] + 1.0 < best[j]:
                best[j], back[j] = best[i] + 1.0, i
        k, kind = i + 1, _kind(piece[i])
        while k <= n:
            cost = 1.5 + (0.25 if kind in (2, 4) else 0.7) * (k - i)
            if best[i] + cost < best[k]:
                best[k], back[k] = best[i] + cost, i
            if k == n or _kind(piece[k]) != kind or k - i >= 12:
                break
            k += 1
    words, at = [], n
    while at:
        words.append(piece[back[at] : at])
        at = back[at]
    return words[::-1]


GRAMMAR = Lexicon({}, {})


def gap_ends_unit(left: str, right: str, lexicon: Lexicon | None = None) -> bool:
    """Whether a gap without a mark ends a sentence, by the lattice words on its two sides and where they stand elsewhere."""
    lexicon = lexicon or GRAMMAR
    before, after = lattice_words(left[-14:].rstrip(_BLANKS), lexicon), lattice_words(right[:10].lstrip(_BLANKS), lexicon)
    return lexicon.leaning((before or [""])[-1], False) + lexicon.leaning((after or [""])[0], True) > 0


# --------------------------------------------------------------------------
# spaced scripts: terminator lattice


def _dot_ends(text: str, at: int, end: int, stop: int, lowered: bool) -> bool:
    """Whether the single dot text[at] (mark cluster and closers up to end) ends a sentence."""
    before = text[at - 1] if at else " "
    after = text[end] if end < stop else ""
    if end == at + 1 and after.isdigit() and before.isdigit():
        return False
    nxt = end
    while nxt < stop and text[nxt] in _BLANKS:
        nxt += 1
    if nxt >= stop:
        return True
    gap = nxt > end
    head = text[nxt]
    if before.isdigit():
        if not gap and not head.isalpha() and head not in "“„«\"(¿¡$":
            return False
        if gap and end == at + 1:
            j = at - 1
            while j >= 0 and (text[j].isdigit()):
                j -= 1
            word = _WORD_BEFORE.search(text[max(0, j - 12) : j + 1].rstrip(_BLANKS))
            if word and text[j] in _BLANKS and word.group().lower().rsplit(".", 1)[-1] in BEFORE_ORDINAL:
                return False
        return True
    if before.isalpha() or before in "ािीुूृेैोौंँः़्":
        word = _WORD_BEFORE.search(text, max(0, at - 14), at)
        token = CJK.split(word.group())[-1] if word else re.split(r"[\s(\[“„«\"]", text[max(0, at - 8) : at])[-1]
        low = token.lower().strip("-")
        if end == at + 1:
            if "." in low and low not in NEVER_END and low not in MAY_END:
                # a blank is missing behind the sentence before
                low = next((low[k + 1 :] for k, ch in enumerate(low) if ch == "." and (low[k + 1 :] in NEVER_END or low[k + 1 :] in MAY_END)), low.rsplit(".", 1)[-1])
                token = token[-len(low) :] if low else token
            if low in NEVER_END:
                return False
            follows = _NEXT_WORD.match(text, nxt, stop)
            part = follows.group().lower() if follows else ""
            if len(low) <= 2 and (low, part) in SPLIT_PARTS and text[follows.end() : follows.end() + 1] == ".":
                return False
            if low in BEFORE_NUMBER and gap and head.isdigit():
                return False
            if low in ("h", "b", "a", "ex", "ej", "m", "g", "e", "t") and at >= 2:
                prior = text[max(0, at - len(low) - 4) : at - len(low)].rstrip(_BLANKS)
                if prior.endswith(".") and len(prior) > 1 and (prior[-2].lower(), low) in SPLIT_PARTS and not prior[-3:-2].isalpha():
                    if low == "m":
                        return gap and _opens(text, nxt, stop, lowered)
                    return False
            if low in MAY_END:
                return head not in ",;:)]”’»-–—" and (not gap or _opens(text, nxt, stop, lowered) or low in ("etc", "usw", "al") and lowered)
            if not gap:
                if head.isupper() or head in "“„«\"(¿¡$":
                    return not (len(low) == 1 and token.isupper())
                return head.isalpha() and len(low) >= 3 and "." not in token and "/" not in text[max(0, at - 12) : at]
    elif not gap and head not in "“„«\"(¿¡$" and not head.isalpha():
        return False
    return head not in ",;"


def _opens(text: str, at: int, stop: int, lowered: bool) -> bool:
    """Whether a sentence can open at text[at]: capital, digit, formula, quote, or a lone variable."""
    ch = text[at]
    if ch.isupper() or ch.isdigit() or ch in "$“„«\"(¿¡「（*#_-" or CJK.match(ch) or ord(ch) > 0x8FF:
        return True
    word = _NEXT_WORD.match(text, at, stop)
    return bool(word) and (len(word.group()) == 1 and word.group() not in "aoàé" or lowered and word.group() not in GOES_ON and word.group() not in ("on", "in", "at"))


def _block(text: str, start: int, stop: int, lowered: bool, spaceless: bool, writes_stops: bool, lexicon: Lexicon, out: list[tuple[int, int]]) -> None:
    begin = start
    while begin < stop and text[begin] in _BLANKS:
        begin += 1

    def cut(end: int) -> None:
        nonlocal begin
        stop_at = end
        while stop_at > begin and text[stop_at - 1] in _BLANKS:
            stop_at -= 1
        if stop_at > begin:
            out.append((begin, stop_at))
        begin = end
        while begin < stop and text[begin] in _BLANKS:
            begin += 1

    # a passage without full stops in a text that writes them: only what the words say ends a unit there
    silent = spaceless and writes_stops and not FULL_STOPS.search(text, start, stop)
    gaps = spaceless and (silent or not writes_stops)
    pos = start
    last = start
    for m in _EVENT.finditer(text, start, stop):
        a, b = m.span()
        if a < pos:
            continue
        if gaps:
            _gaps(text, last, a, stop, cut, lambda: begin, silent, lexicon)
        kind = m.lastgroup
        last = pos = b
        if kind == "math":
            continue
        if kind in ("bracket", "quote"):
            inner = text[a + 1 : b - 1].rstrip(_BLANKS)
            marked = inner[-1:] in TERMINATORS and not inner.endswith("...") if inner else False
            alone = a == begin
            if not marked and not (alone and gaps and not silent):
                continue
            end = _AFTER.match(text, b, stop).end()
            nxt = end
            while nxt < stop and text[nxt] in _BLANKS:
                nxt += 1
            if nxt >= stop:
                cut(end)
                continue
            head = text[nxt]
            if not marked or head in TERMINATORS or head in ",;:，、；：—–-":
                continue
            if alone:
                if kind == "bracket":
                    ends = True
                elif CJK.match(head) or spaceless:
                    asks = inner[-1] in "?？!！"
                    ends = nxt > end or not (asks and _quote_runs_on(text, nxt))
                else:
                    word = _NEXT_WORD.match(text, nxt, stop)
                    low = word.group() if word else ""
                    runs_on = low[:1].islower() and len(low) > 1 and (low in GOES_ON or not lowered or inner[-1] in "?!")
                    ends = not runs_on
                    if ends and ord(head) > 0x8FF and inner[-1] in "?!":
                        ends = False
            elif spaceless and (CJK.match(head)):
                ends = False
            else:
                word = _NEXT_WORD.match(text, nxt, stop)
                ends = kind == "quote" and bool(word) and head.isupper() and len(word.group()) > 1 and ord(head) < 0x900
            if ends:
                cut(end)
                pos = last = max(end, b)
            continue
        mark = m.group()
        if kind == "spaced" and text[b - 1] not in "!?":
            continue
        end = _AFTER.match(text, b, stop).end()
        nxt = end
        while nxt < stop and text[nxt] in _BLANKS:
            nxt += 1
        head = text[nxt] if nxt < stop else ""
        if kind == "dots":
            if not head or head.isupper() and not lowered and (word := _NEXT_WORD.match(text, nxt, stop)) and len(word.group()) > 1:
                cut(end)
                pos = last = end
            continue
        if mark == ".":
            if _dot_ends(text, a, end, stop, lowered):
                cut(end)
                pos = last = end
            continue
        if mark[-1] == "!" and len(mark) == 1 and kind == "term":
            # a factorial: one letter or a closing bracket before, an operator or a word after
            prior = text[a - 1] if a else " "
            lone = (_latin(prior) or prior.isdigit() or prior == ")") and not (a > 1 and _latin(text[a - 2]))
            if lone and head not in "" and (head in "+-−=<>≤≥*/·×)" or CJK.match(head) or head.islower() or head in ",;，、"):
                continue
        if head and head in ",;，、；" and mark[-1] in ".!?":
            continue
        if mark[-1] in "!?" and head.islower() and not lowered and end == b and kind != "spaced" and text[b : b + 1] not in _BLANKS:
            continue
        cut(end)
        pos = last = end
    if gaps:
        _gaps(text, last, stop, stop, cut, lambda: begin, silent, lexicon)
    cut(stop)


def _latin(ch: str) -> bool:
    return ch.isascii() and ch.isalpha() or "Ａ" <= ch <= "ｚ"


# What follows a quoted question inside its sentence.
_QUOTE_RUNS_ON = ("というの", "と", "は", "が", "を", "の", "に", "是", "，", "、", "这", "那", "其实")


def _quote_runs_on(text: str, at: int) -> bool:
    return text.startswith(_QUOTE_RUNS_ON, at)


def _gaps(text: str, a: int, b: int, stop: int, cut, begin, silent: bool, lexicon: Lexicon) -> None:
    for g in _WIDE_GAP.finditer(text, a, b):
        s, e = g.span()
        if s <= begin() or e >= stop:
            continue
        # in texts without full stops gaps end units; beside formula lines, and in silent passages, the words decide
        beside = text.startswith("$$", e) or text[max(0, s - 2) : s] == "$$"
        if (silent or beside) and not gap_ends_unit(text[begin() : s], text[e : e + 16], lexicon):
            continue
        cut(s)


_RUN = re.compile(r"[^\W_]{2,}")


def _writes_capitals(text: str) -> bool:
    """Whether a word holds a capital; lone letters and formulas do not count."""
    head = text.find("$")
    for part in (text if head < 0 else text[:head], "" if head < 0 else re.sub(r"\$[^$]*\$", " ", text)):
        if any(any(map(str.isupper, m.group())) for m in _RUN.finditer(part)):
            return True
        if head < 0:
            return False
    return False


def units(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """Start and end (just behind the last character) of each sentence unit; gaps of spaceless scripts are judged by the lexicon (by grammar alone without one)."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    dense = len(CJK.findall(text))
    latin = sum(map(text.count, "eai")) if dense else 1
    spaceless = dense > 0 and dense * 4 > latin
    bare = re.sub(r"「[^」]*」|“[^”]*”", "", text) if spaceless else text
    writes_stops = not spaceless or bool(FULL_STOPS.search(bare))
    lowered = not _writes_capitals(text)
    lines = []
    at = 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    block: int | None = None
    block_end = 0
    item = False
    in_math = False

    def flush() -> None:
        nonlocal block, item
        if block is not None:
            if item:
                a, b = block, block_end
                while a < b and text[a] in _BLANKS:
                    a += 1
                while b > a and text[b - 1] in _BLANKS:
                    b -= 1
                if b > a:
                    out.append((a, b))
            else:
                _block(text, block, block_end, lowered, spaceless, writes_stops, lexicon or GRAMMAR, out)
        block, item = None, False

    listing = True  # a marker may open an item here: text start, blank line, intro or item before
    for k, (a, b, line) in enumerate(lines):
        bare_line = line.strip(_BLANKS)
        if in_math:
            block_end = b
            if line.count("$$") % 2:
                in_math = False
            continue
        if not bare_line:
            flush()
            listing = True
            continue
        m = _MARKER.match(line)
        first = block is None
        if first and _is_heading(line, lines, k):
            flush()
            out.append((a + len(line) - len(line.lstrip(_BLANKS)), a + len(line.rstrip(_BLANKS))))
            listing = True
            continue
        if m and (listing or item):
            flush()
            block, block_end, item, listing = a, b, True, True
            continue
        if block is None:
            block = a
        elif item and spaceless and not writes_stops:
            flush()
            block = a
        block_end = b
        listing = bare_line[-1] in ":：" or item
        if line.count("$$") % 2:
            in_math = True
    flush()
    return out


def _is_heading(line: str, lines: list, k: int) -> bool:
    """A line that opens a paragraph, ends in no mark, and reads like a title."""
    bare = line.strip(_BLANKS)
    if len(bare) > 110 or bare[-1] in ".!?。！？．｡।,;:，、：；" or bare.startswith("$$"):
        return False
    if _HEADING.fullmatch(line):
        return True
    return False


def unit_arrays(texts: list[str | None], lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row index, unit number, start and end of all units of a batch."""
    rows, nos, starts, ends = [], [], [], []
    for i, text in enumerate(texts):
        found = units(text, lexicon)
        rows.extend([i] * len(found))
        nos.extend(range(len(found)))
        for s, e in found:
            starts.append(s)
            ends.append(e)
    return np.asarray(rows, "int64"), np.asarray(nos, "int32"), np.asarray(starts, "int32"), np.asarray(ends, "int32")


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence unit: id, unit_no (from 0), start_pos, end_pos (code points).

    Null and blank texts have no units; ids may repeat or be null, each row is
    segmented by itself; other columns of the input, whatever their names, are
    not read. The lexicon comes from a first pass over all texts, which shuffles
    only its words; the second is a narrow map with the memory of one Arrow batch.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("unit_no", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    lexicon = learn_lexicon(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nos, starts, ends = unit_arrays(batch.column(1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(nos), pa.array(starts), pa.array(ends)], names=schema.names)

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)
