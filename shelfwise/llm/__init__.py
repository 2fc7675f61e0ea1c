"""Operators for preparing training data: counting, mixing, deduplication, classification, sharding, packing.

Nothing outside this folder imports it.
"""
