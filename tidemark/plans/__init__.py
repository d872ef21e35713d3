"""Whole queries: timeline, search, metrics."""
