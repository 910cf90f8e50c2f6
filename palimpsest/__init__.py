"""Bi-temporal memory analytics and corpus preparation on Spark DataFrames."""
