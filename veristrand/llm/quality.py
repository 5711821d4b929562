"""Line-first cleaning: rules per line, failing lines go, and texts that lose too much are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space between words, the only one that counts here.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Phrases of page furniture and licences.
BOILERPLATE = (
    "all rights reserved", "released under the", "licensed under", "terms of service", "terms of use", "privacy policy",
    "cookie policy", "accept cookies", "enable javascript", "click here", "sign up for our newsletter", "lorem ipsum",
)
BOILERPLATE_PATTERN = re.compile("|".join(BOILERPLATE), re.IGNORECASE | re.ASCII)
ENDINGS = tuple(".!?:;…\"'”’»)]。！？")
#: At most this share of a line's letters may be symbols, and this share exclamation marks.
SYMBOL_SHARE, SHOUT_SHARE = 0.10, 0.08
#: A line of so few words without a closing mark is a menu entry or a heading.
MENU_WORDS = 3
#: A text is rejected when fewer than this share of its words are left.
KEPT_SHARE = 0.5
#: Of the first rule that a line fails.
REASONS = ("symbols", "shouting", "boilerplate", "navigation")

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, n_failed_lines long, n_kept_words long, kept boolean, cleaned string"
)


def failing(line: str) -> str | None:
    """The rule a line with a word fails, if any."""
    words = line.split()
    letters = sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) > SYMBOL_SHARE * letters:
        return "symbols"
    if line.count("!") > SHOUT_SHARE * letters and line.count("!") > 2:
        return "shouting"
    if BOILERPLATE_PATTERN.search(line):
        return "boilerplate"
    if len(words) <= MENU_WORDS and not words[-1].endswith(ENDINGS):
        return "navigation"
    return None


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text, the first included."""
    count = len(words) - size + 1
    if count < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = codes[:count].copy()
    for k in range(1, size):
        windows *= np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
        windows += codes[k : k + count]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(marks) > 0).sum())


def judged(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    lines = text.split("\n")
    worded = [line for line in lines if line.strip(SPACE)]
    repeats = repeated_words(words)
    base_failed = n_words < 10 or 100 * repeats > 20 * n_words
    good = [not line.strip(SPACE) or failing(line) is None for line in lines]
    n_failed = good.count(False)
    cleaned = "\n".join([line for line, ok in zip(lines, good) if ok]) if n_failed else text
    n_left = len(cleaned.encode("utf-8", "surrogatepass").split()) if n_failed else n_words
    return (
        n_words, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)),
        repeats, base_failed, len(worded), n_failed, n_left, not base_failed and n_left >= KEPT_SHARE * n_words, cleaned,
    )


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the counts, the cleaned text and the verdict of each whole text.

    A null text counts as empty and is rejected; blank lines are kept and never judged. A
    result replaces a column of the same name; every other column passes unchanged. A map
    over rows: ties, copies and hot sources change nothing, and nothing is shuffled.
    """

    @F.pandas_udf("struct<" + SCHEMA.replace(" long", ": long").replace(" boolean", ": boolean").replace(" string", ": string") + ">")
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for series in batches:
            yield pd.DataFrame([judged(t) for t in series], columns=names)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    found = docs.withColumn("_llm_quality", rules(F.col(text)))
    return found.withColumns({n: F.col(f"_llm_quality.{n}") for n in names}).drop("_llm_quality")
