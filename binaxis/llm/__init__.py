"""Operators for training-data corpora: dedup, scoring, mixing, packing, search.

Nothing outside this folder imports it, so it can be removed whole.
"""
