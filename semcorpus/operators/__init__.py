"""Corpus operators: DataFrames in, DataFrames out."""
