"""Operators of the engine: each takes DataFrames and gives a DataFrame."""
