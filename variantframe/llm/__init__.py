"""Operators for building training corpora, each over whole Spark tables.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; `queries.py` holds the registered queries.
"""
