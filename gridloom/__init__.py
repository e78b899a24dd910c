"""Lazy raster analytics on Spark DataFrames."""
