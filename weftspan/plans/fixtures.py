"""Pages made from the test tables' ids that hold what those tables' own pages lack; one SQL text that Spark and DuckDB both read.

The expected rows are written down from the ids alone: no oracle searches these pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

#: Attributes in any order, cases and quotes; nested markup; relative, absolute, scheme-less and query references; references that are no links; meta tags.
RICH = """
SELECT page_id, CAST(page_id AS VARCHAR(20)) AS p, concat('https://site', CAST(page_id % 7 AS VARCHAR(20)), '.example') AS origin,
  concat('https://site', CAST(page_id % 7 AS VARCHAR(20)), '.example/a/b', CAST(page_id AS VARCHAR(20))) AS url,
  concat('<!DOCTYPE html><HTML><head><TITLE lang="en"> Page ', CAST(page_id AS VARCHAR(20)), ' &amp; caf&eacute; </TITLE><meta content="About ', CAST(page_id AS VARCHAR(20)), '" NAME="Description"><META name="robots" content="noindex">',
    CASE WHEN page_id % 3 = 0 THEN concat('<link href="/canon/', CAST(page_id AS VARCHAR(20)), '" rel="Canonical">') ELSE '' END, '</head><body><!-- <a href="/commented">no</a> -->',
    '<A class=x href="https://other.example/x', CAST(page_id AS VARCHAR(20)), '" rel="nofollow noopener">Out <b>bold</b> ', CAST(page_id AS VARCHAR(20)), '</A>',
    '<a title="t" href="rel/', CAST(page_id AS VARCHAR(20)), '"> rel </a><a href="?q=', CAST(page_id AS VARCHAR(20)), '">query</a><a href="../up/', CAST(page_id AS VARCHAR(20)), '#frag">up</a>',
    '<a href="mailto:a@b.example">mail</a><a href="javascript:void(0)">js</a><a href="#top">top</a><a href="">none</a><a name="n">nothing</a>',
    '<a href="//cdn.example/', CAST(page_id AS VARCHAR(20)), '">cdn</a><a href="/ro ot/', CAST(page_id AS VARCHAR(20)), '">sp</a>',
    '<a rel="NoFollow" href="https://site', CAST(page_id % 7 AS VARCHAR(20)), '.example/plain">plain &lt;', CAST(page_id AS VARCHAR(20)), '&gt;</a></body></HTML>') AS html
FROM {src}"""

#: The links of RICH's pages: place, target, text, whether external, rel.
_LINKS = (
    ("'https://other.example/x' || p", "'Out bold ' || p", "external", "nofollow noopener"),
    ("origin || '/a/rel/' || p", "'rel'", "internal", ""),
    ("url || '?q=' || p", "'query'", "internal", ""),
    ("origin || '/up/' || p || '#frag'", "'up'", "internal", ""),
    ("'https://cdn.example/' || p", "'cdn'", "external", ""),
    ("origin || '/ro%20ot/' || p", "'sp'", "internal", ""),
    ("origin || '/plain'", "'plain <' || p || '>'", "internal", "NoFollow"),
)
#: DuckDB: `rich` and its links `rlink`.
RICH_SQL = "rich AS (" + RICH.replace("{src}", "pages") + "), rlink AS (" + " UNION ALL ".join(f"SELECT page_id, {k} AS pos, url AS source_url, {u} AS target_url, {t} AS anchor_text, '{kind}' AS link_type, '{rel}' AS rel_attribute FROM rich" for k, (u, t, kind, rel) in enumerate(_LINKS)) + ")"

#: Headers of which none is absent in all rows.
HEADERS = """
SELECT page_id AS id, concat('{"content-type":"', CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/xhtml+xml' END, '","content-length":"', CASE WHEN page_id % 3 = 0 THEN 'none' ELSE concat(CAST(page_id * 10 AS VARCHAR(20)), ' bytes') END,
  '","last-modified":"2024-01-', CASE WHEN page_id % 28 < 9 THEN '0' ELSE '' END, CAST(1 + page_id % 28 AS VARCHAR(20)), ' 03:04:05","content-encoding":"', CASE WHEN page_id % 4 = 0 THEN 'gzip' ELSE 'br' END, '"}') AS response_http_headers
FROM {src}"""


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("weftspan_fixture_source")
    return spark.sql(sql.replace("{src}", "weftspan_fixture_source"))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, RICH)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, HEADERS)
