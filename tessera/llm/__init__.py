"""Operators for preparing training text: search, scans, rules, counts, deduplication, sharding, packing.

Nothing else in the package imports this one; it can be deleted as a whole.
"""
