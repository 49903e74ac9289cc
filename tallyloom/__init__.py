"""Quarterly-statement analytics on Spark DataFrames."""
