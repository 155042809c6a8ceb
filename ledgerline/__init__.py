"""Guarded bulk-change analytics on Spark DataFrames."""
