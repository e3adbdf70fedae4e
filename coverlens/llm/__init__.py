"""Training-data operators: deduplication, search, tokenising, packing, filters.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
