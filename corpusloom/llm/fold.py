"""Texts folded so that case, spacing, punctuation, markup, letter forms and variable names do not matter."""

from __future__ import annotations

import re
import unicodedata

_MARKS = re.compile("[̀-ͯ​‌‍⁠﻿­]")
_TAGS = re.compile(r"</?[a-z][^<>]{0,40}>|&(?:nbsp|amp|lt|gt|quot|#\d{1,5});")
_COMMAND = re.compile(r"\\[a-zA-Z]+")
_VARIABLE = re.compile(r"(?<![a-z])[a-z](?![a-z])")
_WORD = re.compile(r"\d+|[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+")
_NUMBER = re.compile(r"\d+")


def simplify(text: str) -> str:
    """Compatibility forms, lower case, no combining marks, every lone letter one variable."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _MARKS.sub("", text)
    text = text.lower()
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    return _VARIABLE.sub("v", text)


def letters(text: str) -> str:
    """The folded text's letters and digits, without anything between."""
    return re.sub(r"[\W_]+", "", simplify(text))


def words(text: str) -> list[str]:
    """The folded text's words: numbers, alphabetic words, single characters of spaceless scripts."""
    return _WORD.findall(simplify(text).replace("_", " "))


def numbers(text: str) -> list[str]:
    return _NUMBER.findall(text)


#: Stands between texts that are folded in one go; no tag or word reaches over it.
_BETWEEN = "<\x1e>"


def words_of_each(texts: list[str]) -> list[list[str]]:
    """words() of each text."""
    if not texts:
        return []
    return [_WORD.findall(t) for t in simplify(_BETWEEN.join(texts)).replace("_", " ").split(_BETWEEN)]
