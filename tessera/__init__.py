"""Structured-format analytics on Spark DataFrames."""
