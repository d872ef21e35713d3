"""Relational operators over the file-history tables."""
