"""Structured Streaming forms of the cache operators."""
