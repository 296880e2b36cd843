"""Timed-transcript analytics on Spark DataFrames."""
