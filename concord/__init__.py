"""Embedding-agreement analytics and labelled-table algebra on Spark DataFrames."""
