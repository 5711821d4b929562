"""Operators over DataFrames; none of them touches storage."""
