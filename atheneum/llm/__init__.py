"""Operators for preparing training data: deduplication, filtering, mixing, tokenisation.

Nothing outside this subpackage imports it.
"""
