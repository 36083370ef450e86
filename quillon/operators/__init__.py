"""Operators: each takes DataFrames and returns one; nothing is collected on the way."""
