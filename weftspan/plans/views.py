"""A crawl's tables and views under their names, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import with_header_columns
from ..functions.html import ExtractLinks
from ..operators import analytics, graph, lifecycle
from ..session import find_package
from ..sources import schemas
from ..sources.store import Store


def register(spark: SparkSession, warehouse: str) -> list[str]:
    """Temporary views over the last snapshots: pages, link_relations, links, crawl_errors, crawl_meta, completed_pages, queue_status; and the table function extract_links(url, html)."""
    store = Store(spark, warehouse)

    def have(name: str, shape: str) -> DataFrame:
        rows = store.read(name)
        return rows if rows is not None else spark.createDataFrame([], shape)

    pages, links = have("pages", schemas.PAGES), have("links", schemas.LINKS)
    views = {
        "pages": with_header_columns(pages),
        "links": links,
        "link_relations": links.select(graph.node_id(F.col("source_url")).alias("source_page_id"), graph.node_id(F.col("target_url")).alias("target_page_id"), "anchor_text", "link_type", "rel_attribute", "crawled_at"),
        "crawl_errors": have("errors", schemas.ERRORS),
        "crawl_meta": lifecycle.current_meta(have("meta", schemas.META)),
        "completed_pages": analytics.completed_pages(pages),
        "queue_status": analytics.queue_status(pages),
    }
    find_package(spark)
    spark.udtf.register("extract_links", ExtractLinks)
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
    return list(views)
