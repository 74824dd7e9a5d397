"""Training-data operators: quality, deduplication, extraction, tokenisation, sharding.

Nothing outside this subpackage imports it; `queries` holds the registered
queries and `oracles` the SQL they are compared with.
"""
