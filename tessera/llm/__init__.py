"""Training-data operators: search, deduplication, filtering, scoring and mixing.

Nothing else in the library imports this subpackage.
"""
