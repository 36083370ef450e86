"""Schemas and parsed queries: frozen data that no Spark session is needed for."""
