"""Relational operators of the dialect as DataFrames."""
