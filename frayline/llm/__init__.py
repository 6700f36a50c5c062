"""Training-data operators: scoring, filtering, near-duplicates, sharding, tokens, archives.

Nothing outside this subpackage imports it.  Each operator is a function from
DataFrames to a DataFrame; ``queries`` binds them to the tables of a data folder.
"""
