"""Lodestone: a project-knowledge index and query engine on Spark DataFrames."""

__version__ = "0.1.0"
