"""Normalisers from archived provider responses to works, credits and unresolved names.

Every function takes DataFrames of archived responses and returns a ``Lane``.
Places, organizations and account lists are parameters.
"""
