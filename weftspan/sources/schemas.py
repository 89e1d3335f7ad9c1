"""Schemas of the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states of a page.
STATUSES = ("pending", "processing", "completed", "skipped", "error", "discovered")
#: Error types that a retry may cure.
RETRYABLE = ("network_timeout", "connection_refused", "dns_resolution_failed", "server_error_5xx")

PAGES = (
    "id bigint, url string, status string, added_at timestamp, processing_started_at timestamp, status_code int, title string, meta_description string, meta_robots string, canonical_url string, content_hash string, "
    "ttfb_ms bigint, download_time_ms bigint, response_size_bytes bigint, response_http_headers string, crawled_at timestamp, retry_count int, last_error_type string, last_error_message string"
)
LINKS = "source_url string, target_url string, anchor_text string, link_type string, rel_attribute string, crawled_at timestamp"
ERRORS = "url string, error_type string, error_message string, occurred_at timestamp"
ROBOTS = "host string, text string"
META = "key string, value string, seq bigint"
COMPLETED_COLUMNS = (
    "id", "url", "status_code", "title", "meta_description", "meta_robots", "canonical_url", "content_hash", "ttfb_ms", "download_time_ms", "response_size_bytes", "response_http_headers",
    "content_type", "content_length", "last_modified", "server", "content_encoding", "x_cache", "crawled_at",
)


def bad_statuses(pages: DataFrame) -> DataFrame:
    """Rows whose state is none of STATUSES."""
    return pages.where(F.col("status").isNull() | ~F.col("status").isin(*STATUSES))


def upgrade_pages(pages: DataFrame) -> DataFrame:
    """An older pages table with all columns of PAGES, absent ones null (retry_count 0), derived ones left out to be derived anew."""
    have = {c.lower(): c for c in pages.columns}
    if "url" not in have or "status" not in have:
        raise ValueError("a pages table has url and status")
    if bad_statuses(pages).limit(1).count():
        raise ValueError("a page has an unknown status")
    out = []
    for part in PAGES.split(", "):
        name, kind = part.split()
        value = F.col(have[name]).cast(kind) if name in have else F.lit(0 if name == "retry_count" else None).cast(kind)
        out.append((F.coalesce(value, F.lit(0).cast(kind)) if name == "retry_count" else value).alias(name))
    return pages.select(*out)
