"""Spark-first diversity analytics over tidy long tables."""
