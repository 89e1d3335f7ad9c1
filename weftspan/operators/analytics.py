"""Questions about a crawl. Those marked as extensions ask what the tables allow beyond the crawler's own reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headers import with_header_columns
from ..sources.schemas import COMPLETED_COLUMNS


def completed_pages(pages: DataFrame) -> DataFrame:
    """The view of finished pages with the columns that headers give."""
    done = with_header_columns(pages.where("status = 'completed'"))
    return done.select(*[c for c in COMPLETED_COLUMNS if c in done.columns])


def queue_status(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status").agg(F.count("*").alias("count"), F.min("added_at").alias("oldest_item"), F.max("added_at").alias("newest_item"))


def status_counts(pages: DataFrame) -> DataFrame:
    """One row; zeros for an empty table."""
    return pages.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "error")])


def pages_per_status(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status").agg(F.count("*").alias("n"))


def has_queued(pages: DataFrame) -> DataFrame:
    """One row: whether something is pending. Reads no further than the first such page of a task."""
    return pages.where("status = 'pending'").limit(1).agg((F.count("*") > 0).alias("has_queued"))


def totals(pages: DataFrame) -> DataFrame:
    """Pages, those crawled and those in error."""
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "completed").alias("crawled"), F.count_if(F.col("status") == "error").alias("errors"))


def links_per_type(links: DataFrame) -> DataFrame:
    return links.groupBy("link_type").agg(F.count("*").alias("n"))


def slowest(pages: DataFrame, n: int = 10) -> DataFrame:
    return pages.where("status = 'completed'").orderBy(F.desc_nulls_last("ttfb_ms"), "url").limit(n).select("url", "status_code", "ttfb_ms")


def latest_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    return errors.orderBy(F.desc("occurred_at"), "url").limit(n).select("url", "error_type", "error_message", "occurred_at")


def error_pages(pages: DataFrame) -> DataFrame:
    return pages.where("status = 'error'").select("url", "retry_count", "last_error_type")


def duplicate_content(pages: DataFrame) -> DataFrame:
    """Extension: hashes that several pages share; pages without a body ('') don't count."""
    known = pages.where("content_hash IS NOT NULL AND content_hash <> ''")
    return known.groupBy("content_hash").agg(F.count("*").alias("pages"), F.min("url").alias("first_url")).where("pages > 1")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Extension: links whose target answered with 400 or more, or failed."""
    bad = pages.where("status_code >= 400 OR status = 'error'").select(F.col("url").alias("target_url"), "status", "status_code")
    return links.join(bad, "target_url").select("source_url", "target_url", "status", "status_code")


def external_share(links: DataFrame) -> DataFrame:
    """Extension: external and nofollow share of each page's links."""
    nofollow = F.coalesce(F.array_contains(F.split(F.lower("rel_attribute"), r"\s+"), "nofollow"), F.lit(False))
    return links.groupBy("source_url").agg(F.count("*").alias("links"), F.avg((F.col("link_type") == "external").cast("double")).alias("external_share"), F.avg(nofollow.cast("double")).alias("nofollow_share"))


def canonical_mismatch(pages: DataFrame) -> DataFrame:
    """Extension: pages that name another URL as canonical."""
    return pages.where("canonical_url IS NOT NULL AND canonical_url <> '' AND canonical_url <> url").select("url", "canonical_url")


def degrees(links: DataFrame) -> DataFrame:
    """Extension: in and out degree by URL over distinct edges."""
    edges = links.select("source_url", "target_url").distinct()
    end = lambda c, o: F.struct(F.col(c).alias("url"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
    ends = edges.select(F.inline(F.array(end("source_url", 1), end("target_url", 0))))
    return ends.groupBy("url").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def header_distribution(pages: DataFrame) -> DataFrame:
    """Extension: completed pages by content type and server, and how many a cache answered."""
    done = with_header_columns(pages.where("status = 'completed'"))
    return done.groupBy("content_type", "server").agg(F.count("*").alias("pages"), F.count_if(F.lower("x_cache").startswith("hit")).alias("cache_hits"))


def error_histogram(errors: DataFrame) -> DataFrame:
    """Extension: errors by type."""
    return errors.groupBy("error_type").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))
