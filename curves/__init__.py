"""Curves: futures-spread analytics on Spark DataFrames."""
