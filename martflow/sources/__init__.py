"""Readers: topics, change feeds, dimension and statistics tables, test tables."""
