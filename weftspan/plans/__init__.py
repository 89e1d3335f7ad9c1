"""Queries over the test tables, by name."""
