"""Structured corpus analytics on Spark: segments, facts, graphs, retrieval and accounting as DataFrames."""
