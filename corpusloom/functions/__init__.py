"""Column functions: vectors, text, statistics."""
