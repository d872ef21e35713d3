"""Column functions: text and paths, time, vectors, JSON."""
