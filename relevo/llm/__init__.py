"""Training-data operators: ten corpus-scale operators and their queries.

Nothing else in the library imports this package; it imports only general
helpers (session, shared tables). Every operator takes DataFrames and returns
DataFrames; ``registry`` holds the named queries and their SQL oracles.
"""
