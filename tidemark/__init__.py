"""Tidemark: file-history timelines and semantic search as Spark plans."""
