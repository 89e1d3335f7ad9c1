"""Spark-native analysis of crawled pages, their link graph and the crawl frontier."""

__version__ = "0.1.0"
