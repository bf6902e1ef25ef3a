"""Training-data operators: packing, scoring, deduplication, search and encoding.

Nothing else in the library imports this subpackage.
"""
