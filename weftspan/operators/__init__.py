"""Relational operators: the link graph, the life of a page, and analytics."""
