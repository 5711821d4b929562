"""Archived HTML pages taken apart into links, blocks, lines and text.

All tag work is regular expressions in the JVM. Parts come out as rows, one page
being the largest group anything is ordered within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_text, or_empty, unescape

# Elements whose content is no text, and tags that end a line.
HIDDEN = r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:br|p|div|h[1-6]|li|tr|section|article|ul|ol|table|header|footer|nav|main)\b[^>]*>"
TAG = r"(?s)<[^>]*>"
ANCHOR = r"""(?is)(<a\b[^>]*>.*?</a\s*>)"""
HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
BLOCK = r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>)"


def visible(html: Column) -> Column:
    return F.regexp_replace(or_empty(html), HIDDEN, " ")


def inner_text(html: Column) -> Column:
    """Text of a fragment on one line, character references still in place."""
    return F.regexp_replace(or_empty(html), TAG, " ")


def fragment_text(html: Column) -> Column:
    return compact_text(inner_text(html))


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(or_empty(tag), rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def page_title(html: Column) -> Column:
    return fragment_text(F.regexp_extract(or_empty(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def first_heading(html: Column, level: str = "h1") -> Column:
    return fragment_text(F.regexp_extract(or_empty(html), rf"(?is)<{level}\b[^>]*>(.*?)</{level}\s*>", 1))


def page_text(html: Column) -> Column:
    """Non-empty lines of visible text, one per block element, joined by newlines."""
    broken = F.regexp_replace(F.regexp_replace(visible(html), BREAKS, "\n"), TAG, "")
    plain = F.regexp_replace(unescape(broken), r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def page_links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, href, label) of every anchor with a target."""
    anchors = pages.select(key, F.posexplode(F.regexp_extract_all(or_empty(F.col(html)), F.lit(ANCHOR), 1)).alias("pos", "anchor"))
    href = F.concat(*[F.regexp_extract("anchor", HREF, i) for i in (1, 2, 3)])
    return anchors.select(key, "pos", unescape(href).alias("href"), fragment_text(F.col("anchor")).alias("label")).filter("href != ''")


def page_blocks(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, tag, text) of headings, paragraphs and list items that hold text."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(visible(F.col(html)), F.lit(BLOCK), 1)).alias("pos", "block"))
    return blocks.select(
        key, "pos", F.lower(F.regexp_extract("block", r"(?is)^<(h[1-6]|p|li)\b", 1)).alias("tag"),
        fragment_text(F.col("block")).alias("text")).filter("text != ''")


def page_lines(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, line) of the visible text."""
    return text_lines(pages.select(key, page_text(F.col(html)).alias("text")), key)


def text_lines(texts: DataFrame, key: str) -> DataFrame:
    split = F.posexplode(F.split(F.replace("text", F.lit("\f"), F.lit("\n")), "\n"))
    return texts.select(key, split.alias("pos", "line")).select(
        key, "pos", F.trim(F.regexp_replace("line", r"(?U)\s+", " ")).alias("line")).filter("line != ''")


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, host-relative and path-relative targets."""
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"(?i)^(https?://[^/]+.*/)", 1)
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"(?i)^(https?:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))
    )
