"""Waymark: exact spatio-temporal trajectory queries on Spark DataFrames."""
