"""Training-data operators: deduplication, tokenizing, scoring, sharding, packing, filtering.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
