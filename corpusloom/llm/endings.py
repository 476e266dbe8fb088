"""How a text ends: whole, or cut in mid-word or mid-sentence.

What transfer puts behind a text (blanks, closing braces of an envelope, line
break tags, half an entity) is set aside first, then marks put behind a cut and
end-of-proof marks; what remains is judged by its last characters.
"""

from __future__ import annotations

import re
from collections import Counter

from corpusloom.llm.segment import BEFORE_NUMBER, BEFORE_ORDINAL, CJK, MAY_END, NEVER_END

WHOLE, CUT, UNSURE = 0, 1, 2

# Marks that end a proof.
_END_MARK = re.compile(
    r"(?:[∎□■▪◻◼⬛⊠]|\\(?:qed|blacksquare|square|Box)|\$\\(?:qed|blacksquare|square|Box)\$|Q\.\s?E\.\s?D\.?|q\.\s?e\.\s?d\.?|QED|C\.\s?Q\.\s?F\.\s?D\.?|CQFD|c\.q\.f\.d\.|w\.\s?z\.\s?b\.\s?w\.|W\.z\.b\.w\.|Fin\.?|Ende\.?|（証明終(?:わ?り|了)?）|証明終(?:わ?り|了)?。?|（終わり?）|以上。?|（证毕）|证毕[。．｡]?|證畢[。．｡]?)$"
)
_DEBRIS = re.compile(r"(?:\s|[​‌‍⁠﻿\x00-\x1f ]|//+|<br\s*/?>|</?(?:p|div|span|body|html)>|\s<[a-z/]{0,6}|&[a-z#]{1,7}\d*;?|\\+[nrt]?|\"?\s*\}+\]*(?<=\"\})|\"\]?\}|\"\s*,?)$")
_CUT_MARK = re.compile(r"(?:…+|\.{3,}|[—–]|\s-{2,}|�+|\[(?:cut|truncated|…|\.\.\.|more|continued)\]|\((?:cut|truncated|continued)\))$", re.I)
_REFERENCE = re.compile(r"(?:\[[\w,;– -]{1,12}\]|[¹²³⁰-⁹])+$")
_TERM = "。．｡！？!?।"
_CLOSE = ")）]】”’»」』›\"'*_"
_OPEN = {")": "(", "）": "（", "]": "[", "】": "【", "”": "“", "»": "«", "」": "「", "』": "『", "›": "‹"}
_NUMBER_DOT = re.compile(r"\d\d?\.(?:(?=\d)|\s+(?=\S))")
_TOKEN = re.compile(r"[^\W\d_]+|[\d_]+")
_LAST_WORD = re.compile(r"[^\W\d_]+(?:[.\-]+[^\W\d_]+)*$")
_QUOTED_END = re.compile(r"[“«「『„]")


def _pairs_open(text: str, mark: str) -> bool:
    """Whether the closing mark at the end has its opening mark in the text."""
    opener = _OPEN.get(mark)
    return opener is None or text.count(opener) >= text.count(mark)


def context(before: str) -> str | None:
    """What stands before a number: the last two words, of spaceless scripts the last two characters; None where no word stands there."""
    found = _TOKEN.findall(before[-40:])
    if not found or not found[-1][0].isalpha():
        return None
    last = found[-1].lower()
    if CJK.match(last[-1]):
        return last[-2:]
    return f"{found[-2].lower() if len(found) > 1 and found[-2][0].isalpha() else ''} {last}"


def number_contexts(text: str) -> Counter:
    """(context, whether decimals follow) of the numbers of one or two digits with a dot behind, the text's last one left out."""
    out: Counter = Counter()
    for m in _NUMBER_DOT.finditer(text):
        a, b = m.span()
        if (not a or text[a - 1] not in ".," and not text[a - 1].isdigit()) and (c := context(text[max(0, a - 40) : a])):
            out[c, text[b - 1] == "."] += 1
    return out


def before_debris(text: str) -> str:
    """The text without what transfer and marks of a cut put behind it."""
    base = text
    while base:
        m = _DEBRIS.search(base, max(0, len(base) - 40)) or _CUT_MARK.search(base, max(0, len(base) - 16))
        if not m or m.start() == m.end():
            break
        base = base[: m.start()]
    return base


def ending(text: str | None, decimal: frozenset[str] = frozenset()) -> tuple[int, bool]:
    """WHOLE, CUT or UNSURE (a dot that may stand inside a number), and whether a cut mark stood behind.

    `decimal` holds the contexts in which numbers go on behind their dot.
    Empty and blank texts are WHOLE: they hold no cut sentence.
    """
    if not text:
        return WHOLE, False
    base = text
    marked = proved = False
    while base:
        m = _DEBRIS.search(base, max(0, len(base) - 40))
        if m and m.group() in ('"', '" ') and base.count('"') % 2 == 0:
            m = None
        if not m:
            m = _CUT_MARK.search(base, max(0, len(base) - 16))
            if m and not proved:
                marked = True
                if "\ufffd" in m.group():
                    return CUT, True  # part of a character: the next word had begun
        if not m:
            m = _END_MARK.search(base, max(0, len(base) - 14))
            if m and m.start() and base[m.start() - 1].isalpha() and not CJK.match(base[m.start() - 1]):
                m = None
            proved = proved or bool(m)
        if not m or m.start() == m.end():
            break
        base = base[: m.start()]
    if not base.strip():
        return WHOLE, marked
    if base.count("$$") % 2 or (base.replace("$$", "").count("$") % 2):
        return CUT, marked
    if base.endswith("$$"):  # a formula line: whole unless the sentence before it still waits for its end
        before = _REFERENCE.sub("", base[: base.rfind("$$", 0, len(base) - 2)].rstrip()).rstrip(_CLOSE + "“")
        return (WHOLE if not before or before[-1] in _TERM + ".:：" or before.endswith("$$") else CUT), marked
    bare = _REFERENCE.sub("", base) if base[-1] in "]⁰¹²³⁴⁵⁶⁷⁸⁹" else base
    if bare is not base and bare and bare[-1] in _TERM + ".":
        return WHOLE, marked
    at = len(base)
    close = _CLOSE + "“" if "„" in base else _CLOSE
    while at and base[at - 1] in close and _pairs_open(base[:at], base[at - 1]):
        at -= 1
        while at and base[at - 1] in "   ":
            at -= 1
    inner = base[:at]
    if not inner:
        return WHOLE, marked
    last = inner[-1]
    if last in _TERM:
        if last == "!" and len(inner) > 1 and (inner[-2].isascii() and inner[-2].isalpha() or inner[-2] == ")") and not (len(inner) > 2 and inner[-3].isalpha() and inner[-3].isascii()):
            return CUT, marked
        return WHOLE, marked
    if last == ".":
        line = base[max(base.rfind("\n"), len(base) - 400, 0) :]
        return _dot(inner, decimal, any(line.rfind(a) > line.rfind(b) for a, b in ("()", "（）"))), marked
    if CJK.search(base[-3:]) and not re.search("[。．｡]", text) and not marked and last not in "，、,：:；" and re.search(r"[\n　]", base.strip()):
        return UNSURE, marked  # a text that writes no full stops
    return CUT, marked


def _dot(inner: str, decimal: frozenset[str], bracket_open: bool) -> int:
    before = inner[:-1]
    if before.endswith(".."):
        return CUT
    if before[-1:].isdigit():
        digits = re.search(r"\d+$", before).group()
        rest = before[: -len(digits)]
        if rest.endswith((".", ",")) and rest[-2:-1].isdigit():
            return WHOLE
        word = _LAST_WORD.search(rest.rstrip())
        if word and word.group().lower() in BEFORE_ORDINAL:
            return CUT
        if len(digits) > 2:
            return WHOLE
        if bracket_open:
            return CUT
        return CUT if context(rest) in decimal else UNSURE
    word = _LAST_WORD.search(before[-16:])
    low = word.group().lower() if word else ""
    if word and CJK.match(low[:1]):
        low = CJK.split(low)[-1]
    if len(low) > 1 and (low in NEVER_END or low in BEFORE_NUMBER):
        return CUT
    if low in MAY_END:
        return WHOLE
    if len(low) == 1 and low in "dzeihbgcv" and before[-2:-1] in "  .":
        # the first or second part of a split abbreviation
        return CUT if low in "dzeihg" or before[-2:-1] == "." else UNSURE
    if before[-3:-1] == "p." or low in ("p.ex", "p.ej"):
        return CUT
    if low in ("ex", "ej", "h", "b", "a") and before[: -len(low)].rstrip().endswith("."):
        return CUT
    return WHOLE
