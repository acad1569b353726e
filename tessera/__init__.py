"""Tessera: registry analytics on Spark DataFrames."""
