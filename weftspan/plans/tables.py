"""Crawl tables made from the test tables; one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pages in all states, by arithmetic on page_id; times are plain numbers.
LIFE = """
SELECT page_id AS id, url,
  CASE WHEN page_id % 10 IN (0, 1) THEN 'pending' WHEN page_id % 10 = 2 THEN 'processing' WHEN page_id % 10 = 3 THEN 'error'
       WHEN page_id % 10 = 4 THEN 'skipped' WHEN page_id % 10 = 5 THEN 'discovered' ELSE 'completed' END AS status,
  CAST((page_id * 7919) % 1000 AS BIGINT) AS added_at,
  CASE WHEN page_id % 10 = 2 AND page_id % 3 <> 0 THEN CAST((page_id * 31) % 100 AS BIGINT) END AS processing_started_at,
  CASE WHEN page_id % 10 >= 6 THEN CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 500 ELSE 200 END END AS status_code,
  CASE WHEN page_id % 10 >= 6 THEN CAST((page_id * 131) % 900 AS BIGINT) END AS ttfb_ms,
  CASE WHEN page_id % 10 = 3 THEN CAST(page_id % 7 AS INT) ELSE 0 END AS retry_count,
  CASE WHEN page_id % 10 = 3 THEN CASE WHEN page_id % 11 = 0 THEN 'processing_error' WHEN page_id % 3 = 0 THEN 'network_timeout' WHEN page_id % 3 = 1 THEN 'network_error' ELSE 'server_error_5xx' END
       WHEN page_id % 10 = 4 THEN 'robots_txt_disallow' END AS last_error_type,
  CAST(NULL AS VARCHAR(200)) AS last_error_message,
  CASE WHEN page_id % 10 >= 6 THEN concat('{"content-type":"', CASE WHEN page_id % 7 = 0 THEN 'application/json' ELSE 'text/html; charset=utf-8' END,
       '","content-length":"', CAST(length(html) AS VARCHAR(20)), CASE WHEN page_id % 9 = 0 THEN 'b' ELSE '' END, '","server":"srv', CAST(page_id % 3 AS VARCHAR(20)),
       CASE WHEN page_id % 4 = 0 THEN '","x-cache":"HIT' ELSE '' END, '","last-modified":"Mon, 02 Jan 2006 15:04:05 GMT"}') END AS response_http_headers
FROM {src}"""


def life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in all states."""
    # the text has braces of its own; a query is bound to the view's rows at once, so the name may be used again
    table(spark, sf_dir, "pages").createOrReplaceTempView("weftspan_life_source")
    return spark.sql(LIFE.replace("{src}", "weftspan_life_source"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as the error log."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("concat('https://user', user_id, '.example/') AS url", "event_type AS error_type", "props AS error_message", "ts AS occurred_at", "event_id")
