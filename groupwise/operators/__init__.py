"""Operators on DataFrames: grouped frames and positional gather."""
