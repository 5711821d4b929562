"""Folding, word tokens, name keys and small text clean-ups."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_RUN = r"[\p{L}\p{N}]+"
NON_ASCII = r"[^\x00-\x7F]"


def _marks_removed(value: str) -> str:
    folded = unicodedata.normalize("NFKD", value).casefold()
    return "".join(c for c in folded if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold_beyond_ascii(values: pd.Series) -> pd.Series:
    return values.map(_marks_removed, na_action="ignore")


def _ascii_first(value: Column, udf) -> Column:
    """ASCII rows are folded in the JVM; only the others carry text to Python."""
    foreign = value.rlike(NON_ASCII)
    return F.coalesce(udf(F.when(foreign, value)), F.lower(value))


def _case_folding() -> tuple[str, str, dict[str, str]]:
    """Where folding goes further than lower case: one-to-one pairs and expansions."""
    plain, folded, expanded = [], [], {}
    for point in range(0x80, 0x10000):
        char = chr(point)
        target = char.casefold()
        if target != char and char.lower() == char:
            if len(target) == 1:
                plain.append(char)
                folded.append(target)
            else:
                expanded[char] = target
    return "".join(plain), "".join(folded), expanded


_FOLD_FROM, _FOLD_TO, _EXPANDED = _case_folding()


def casefold(value: Column) -> Column:
    """Unicode case folding in the JVM; rows that need more than ``lower`` are told by their letters."""
    lowered = F.lower(value)
    single = F.translate(lowered, _FOLD_FROM, _FOLD_TO)
    table = F.create_map(*[F.lit(text) for pair in _EXPANDED.items() for text in pair])
    spelled = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return (
        F.when(~lowered.rlike(NON_ASCII), lowered)
        .when(single.rlike("[" + "".join(_EXPANDED) + "]"), spelled)
        .otherwise(single)
    )


def name_key(value: Column) -> Column:
    """Compatibility-decomposed, case-folded words joined by one space."""
    folded = _ascii_first(value, _fold_beyond_ascii)
    return F.array_join(F.regexp_extract_all(folded, F.lit(f"({WORD_RUN})"), 1), " ")


_WORDS = re.compile(r"[^\W_]+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_keys(values: pd.Series) -> pd.Series:
    """``name_key`` over an array column (one record's name and aliases)."""
    return values.map(
        lambda names: [" ".join(_WORDS.findall(_marks_removed(n))) for n in names if n is not None],
        na_action="ignore",
    )


def _latin_folding() -> tuple[str, str]:
    """Single-mark Latin letters and their bases, from the Unicode decompositions.

    Combining marks come last with no counterpart, which makes ``translate``
    delete them.
    """
    letters, bases = [], []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for point in block:
            parts = unicodedata.normalize("NFD", chr(point))
            if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
                letters.append(chr(point))
                bases.append(parts[0].lower())
    marks = "".join(chr(point) for point in range(0x0300, 0x0370))
    return "".join(letters) + marks, "".join(bases)


_LATIN, _LATIN_BASE = _latin_folding()


def search_fold(value: Column) -> Column:
    """Case and single Latin accents folded, entirely in the JVM."""
    lowered = F.lower(value)
    return F.when(
        lowered.rlike(NON_ASCII), F.translate(lowered, _LATIN, _LATIN_BASE)
    ).otherwise(lowered)


def search_tokens(value: Column) -> Column:
    return F.regexp_extract_all(search_fold(value), F.lit(f"({WORD_RUN})"), 1)


def search_fold_text(value: str) -> str:
    """``search_fold`` for a query string on the driver."""
    table = {ord(a): b for a, b in zip(_LATIN, _LATIN_BASE)}
    table.update({point: None for point in range(0x0300, 0x0370)})
    return value.lower().translate(table)


def query_words(query: str) -> list[str]:
    """The literal words of a user query; operators and punctuation mean nothing."""
    return re.findall(r"\w+", query, re.UNICODE)


def word_tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"(?U)(\w+)"), 1)


def squeeze(value: Column) -> Column:
    """Runs of white space become one blank; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    import html

    return values.map(html.unescape, na_action="ignore")


def unescape(value: Column) -> Column:
    """HTML character references; only rows that hold an ampersand go to Python."""
    return F.coalesce(_unescape(F.when(F.contains(value, F.lit("&")), value)), value)


def compact_text(value: Column) -> Column:
    return squeeze(unescape(F.coalesce(value, F.lit(""))))


def clean_html(value: Column) -> Column:
    return compact_text(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]*>", " "))


def slug(value: Column) -> Column:
    dashed = F.regexp_replace(casefold(value), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def sentence(template: str, **parts: Column) -> Column:
    """A text with ``{name}`` places, filled from the given columns or from columns of that name."""
    pieces = re.split(r"\{(\w+)\}", template)
    filled = [parts.get(piece, F.col(piece)) if i % 2 else F.lit(piece) for i, piece in enumerate(pieces) if i % 2 or piece]
    return F.concat(*filled)
