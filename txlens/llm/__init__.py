"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to DataFrames; ``catalog`` holds the thin registered
queries and their DuckDB oracle text.
"""
