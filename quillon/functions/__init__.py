"""Compiled scalar functions: values, expressions, text, geo, vectors, bits, JSON."""
