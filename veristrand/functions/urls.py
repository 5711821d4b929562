"""Comparable keys for URLs and external identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold

# Authority of an HTTP(S) reference, and its path without trailing slashes plus its query.
_AUTHORITY = r"(?i)^https?://([^/?#]*)"
# A reference without query, fragment, blanks or capitals in its host: its key takes no further pattern.
_PLAIN = r"^https?://[a-z0-9.:@-]+(?:/[^?#\x00-\x20\x85\u2028\u2029]*)?\z"
_REST = r"(?is)^https?://[^/?#]*([^?#]*?)/*(\?[^#]+)?\??(?:#.*)?$"


def _tidy(value: Column) -> Column:
    return F.when(value.rlike(r"[\x00-\x20]"), F.regexp_replace(value, r"^[\x00-\x20]+|[\t\r\n]", "")).otherwise(value)


def is_http_url(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tidy(value), _AUTHORITY, 1) != "", F.lit(False))


def url_key(value: Column) -> Column:
    """https + lower-case host without ``www.`` + path without trailing slashes + query.

    Empty or NULL gives ''. Anything that is not an HTTP(S) URL gives NULL, which
    callers treat as a rejected row.
    """
    url = _tidy(value)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r"^www\.", "")
    bare = F.substring(value, F.instr(value, F.lit("//")) + 2, F.length(value))
    bare = F.when(F.startswith(bare, F.lit("www.")), F.substring(bare, 5, 1 << 30)).otherwise(bare)
    return (
        F.when(value.isNull() | (value == ""), F.lit(""))
        .when(value.rlike(_PLAIN), F.concat(F.lit("https://"), F.rtrim(bare, F.lit("/"))))
        .when(F.regexp_extract(url, _AUTHORITY, 1) != "", F.concat(F.lit("https://"), host, F.regexp_replace(url, _REST, "$1$2")))
    )


def last_segment(value: Column) -> Column:
    """Text after the last slash once trailing slashes are gone."""
    return F.substring_index(F.rtrim(value, F.lit("/")), "/", -1)


def tail(value: Column) -> Column:
    """Text after the last slash, trailing slash included."""
    return F.substring_index(value, "/", -1)


def identifier_key(namespace: Column, value: Column) -> Column:
    trimmed = F.trim(value)
    return (
        F.when(namespace == "profile_url", F.nullif(url_key(trimmed), F.lit("")))
        .when(namespace.isin("orcid", "ror"), casefold(last_segment(trimmed)))
        .when(namespace.isin("email", "github"), casefold(trimmed))
        .otherwise(trimmed)
    )


def github_repository(value: Column) -> Column:
    """owner/name in lower case from any of the usual repository URL spellings, else ''."""
    text = F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("git+"), F.lit("")), r"\.git$", "")
    owner = F.regexp_extract(text, r"(?i)github\.com[:/]([^/\s]+)/([^/#?\s]+)", 1)
    name = F.regexp_extract(text, r"(?i)github\.com[:/]([^/\s]+)/([^/#?\s]+)", 2)
    return F.when(owner == "", F.lit("")).otherwise(F.lower(F.concat_ws("/", owner, name)))


def github_account(value: Column) -> Column:
    """The account name of a profile URL or a bare handle."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^https://github\.com/", "")
    bare = F.regexp_replace(bare, r"^http://github\.com/", "")
    return F.substring_index(F.trim(bare, F.lit("/")), "/", 1)
