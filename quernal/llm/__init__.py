"""Operators of a training-data pipeline: deduplication, tokenising, mixing, filtering, sharding.

Nothing outside this subpackage imports it.
"""
