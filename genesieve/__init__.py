"""Ranking entities from large event tables with plain Spark DataFrames.

Every operator takes DataFrames and returns DataFrames.  Column names are
parameters, so the same operator serves genes and mutations or parts and line
items.
"""

__version__ = "0.1.0"
