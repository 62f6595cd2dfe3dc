"""Training-data operators: near-duplicates, filters, archives, mixing, sharding, counts.

Nothing outside this subpackage imports it.
"""
