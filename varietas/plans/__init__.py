"""Named queries with their SQL mirrors."""
