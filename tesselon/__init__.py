"""Tesselon: recordings-and-networks analytics on Spark DataFrames."""
