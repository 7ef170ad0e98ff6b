"""Screening analytics on Spark DataFrames."""
