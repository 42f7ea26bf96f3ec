"""Constructors, readers and writers."""
