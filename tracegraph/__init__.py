"""Trace and code-graph analytics on Spark DataFrames and streams."""
