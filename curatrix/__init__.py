"""Curatrix: document curation for many tasks at once, on Spark DataFrames."""
