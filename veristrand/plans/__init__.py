"""Compositions of the operators over stored tables."""
