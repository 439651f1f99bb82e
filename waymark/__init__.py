"""Waymark: documentation routing analytics expressed as Spark DataFrames."""
