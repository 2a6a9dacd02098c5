"""Grounded-document analytics on Spark DataFrames."""
