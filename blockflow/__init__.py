"""Declarative block pipelines on Spark DataFrames."""
