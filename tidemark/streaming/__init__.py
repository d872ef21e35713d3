"""Structured Streaming forms of the change feed."""
