"""Structured Streaming forms of logs, groups, channels and rate limits."""
