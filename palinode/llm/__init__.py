"""Operators of a training-data pipeline over the tables `documents`, `pages` and `benchmark`.

Each module holds one operator with its general interface; `queries` holds the thin registered queries and
their SQL counterparts. Nothing else in the library imports this package.
"""
