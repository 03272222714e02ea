"""Operators for preparing training corpora: sharding, tokenising, dedup, extraction, mixing, quality.

Nothing outside this subpackage imports it.
"""
