"""Operators over texts and code for training data."""
