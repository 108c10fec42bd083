"""Relational, graph, retrieval and linkage operators: DataFrames in, DataFrames out."""
