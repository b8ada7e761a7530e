"""Clickstream analytics expressed as Spark DataFrames and streaming queries."""
