"""Positional analytics on Spark DataFrames."""
