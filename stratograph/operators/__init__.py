"""Operators over DataFrames; every function returns a lazy DataFrame unless it says otherwise."""
