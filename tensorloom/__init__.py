"""Sparse tensor and matrix analytics on Spark DataFrames."""
