"""Training-data operators: quality, privacy, deduplication, scoring, packing.

Nothing outside this subpackage imports it.  Modules are imported one by one by
the query registry, so that a worker loads only what its operator needs.
"""
