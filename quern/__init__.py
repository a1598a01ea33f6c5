"""Quern: a filter-language analytics engine on Spark DataFrames."""
