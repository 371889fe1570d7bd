"""Typed n-dimensional arrays and array analytics over Spark DataFrames."""
