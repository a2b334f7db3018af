"""Training-data operators: near-duplicates, packing, scans, mixing, sharding, search.

Nothing outside this subpackage imports it.  Every module offers one operator
with a general interface; ``queries`` holds the registered queries.
"""
