"""Text functions of the corpus bookkeeping, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a strip removes: all of Unicode's, not only blanks.
WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_all(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), f"^{WHITE}|{WHITE}$", "")


def id_part(c: Column | str, k: int) -> Column:
    """Part k (from 1) of an id joined by double underscores; null when missing or null."""
    return F.nullif(F.split_part(_col(c), F.lit("__"), F.lit(k)), F.lit(""))


def composite_id(*parts: Column | str) -> Column:
    """Parts joined by double underscores; null when any part is."""
    return F.when(F.greatest(*[_col(p).isNull().cast("int") for p in parts], F.lit(0)) == 0, F.concat_ws("__", *[_col(p).cast("string") for p in parts]))


def short_hash(c: Column | str) -> Column:
    """The first eight characters of the md5."""
    return F.substring(F.md5(_col(c)), 1, 8)


def cache_name(path: Column | str) -> Column:
    """Corpus path -> cache name: base name without extension and corpus prefix, dots as underscores."""
    base = F.element_at(F.split(_col(path), "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.replace(F.regexp_replace(stem, "^proofs_", ""), F.lit("."), F.lit("_"))


def quote_regex(text: str) -> str:
    """A literal for a regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def starts_word(form: str, literal: bool = True) -> str:
    """A case-insensitive pattern with a boundary before the form and none behind."""
    return r"(?iu)(^|[^\p{L}\p{M}\p{N}_])(?:" + (quote_regex(form) if literal else form) + ")"


def fill_template(template: Column | str, **values: Column | str) -> Column:
    """Replaces {name} by the value; null when the template or a value is null."""
    out = _col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _col(value))
    return out
