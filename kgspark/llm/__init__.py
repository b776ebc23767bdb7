"""Operators for large text corpora: deduplication, filtering, tokenizers and scores.

Nothing outside this package imports it.
"""
