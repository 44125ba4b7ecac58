"""Column functions: literals, names, statistics."""
