"""The crawl as micro-batches."""
