"""Scalar functions and predicates over URLs, HTML, headers and robots rules."""
