"""Intermediate tables on storage that every executor reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import concluded, discard, staged

__all__ = ["concluded", "discard", "staged", "told"]


def told(frame: DataFrame, most: int) -> DataFrame:
    """Sent to every task while a stored table has few rows; beyond that, joins shuffle both sides."""
    return F.broadcast(frame) if frame.count() <= most else frame
