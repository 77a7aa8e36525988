"""Retrieval, text and service-log analytics on Spark DataFrames."""
