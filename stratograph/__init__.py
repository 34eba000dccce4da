"""Stratograph: hierarchical property graphs and code-collection processing on Spark DataFrames."""

__version__ = "0.1.0"
