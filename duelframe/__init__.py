"""Pairwise-outcome analytics on Spark DataFrames."""
