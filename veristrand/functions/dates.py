"""Dates as providers and pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

_OFFSET = r"[Tt ]\d{2}:?\d{2}(:?\d{2}([.,]\d+)?)?(Z|z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"


def has_timezone(value: Column) -> Column:
    """An ISO date-time that names its offset and parses."""
    parsed = F.try_to_timestamp(value)
    return F.coalesce(value.rlike(r"^\d{4}-?\d{2}-?\d{2}") & value.rlike(_OFFSET) & parsed.isNotNull(), F.lit(False))


def iso_date(value: Column) -> Column:
    """YYYY-MM-DD from the accepted spellings; '' when unknown."""
    text = squeeze(value)
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}([Tt ].*)?$"),
        F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")),
    )
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    # month/day/year, year/month/day and month-day-year.
    spelled = [F.try_to_timestamp(text, F.lit(p)) for p in ("M/d/yyyy", "yyyy/M/d", "M-d-yyyy")]
    guarded = [
        F.when(text.rlike(shape), parsed)
        for shape, parsed in zip(
            (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$"), spelled
        )
    ]
    return F.coalesce(F.date_format(F.coalesce(iso, compact, *guarded), "yyyy-MM-dd"), F.lit(""))


def rfc822_date(value: Column) -> Column:
    """The calendar day of a feed's publication time; '' when it does not parse."""
    day = F.regexp_extract(value, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    return F.coalesce(
        F.date_format(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("d MMM yyyy")), "yyyy-MM-dd"), F.lit("")
    )
