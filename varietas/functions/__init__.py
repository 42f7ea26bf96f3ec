"""Column-level numerics."""
