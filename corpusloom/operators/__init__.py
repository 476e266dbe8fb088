"""Operators over corpus DataFrames."""
