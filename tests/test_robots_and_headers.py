from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftspan.functions import headers as D
from weftspan.functions import robots as R
from weftspan.sources.fetch import allowed_by

TEXT = """# comment
User-agent: *
Disallow: /private/
Allow: /private/open/
Disallow: /*.pdf
Crawl-delay: 2
Sitemap: https://a/s.xml
User-agent: other
Disallow: /
User-agent: My-Crawler-X
Disallow: /x
bad line
"""


def test_parse():
    got = R.parse(TEXT)
    assert got.disallow == ["/private/", "/*.pdf", "/x"] and got.allow == ["/private/open/"] and got.crawl_delay == 2 and got.sitemaps == ["https://a/s.xml"]


@pytest.mark.parametrize(("text", "want"), [("User-agent: *\nCrawl-delay: 1.5", 1.5), ("User-agent: *", 0), ("User-agent: *\nCrawl-delay: soon", 0), ("User-agent: *\nCrawl-delay: 0", 0), ("User-agent: webCrawler\nCrawl-delay: 5", 5), ("Crawl-delay: 5", 0), ("User-agent: *\nUser-agent: b\nCrawl-delay: 3", 0)])
def test_delay(text, want):
    assert R.parse(text).crawl_delay == want


PATTERNS = [
    ("/a/b", "/a", True), ("/b", "/a", False), ("/a.pdf", "/*.pdf", True), ("/a.pdf?x", "/*.pdf", True), ("/a.pdf", "*.pdf$", False), ("/a.pdf$", "*.pdf$", True), ("/a", "/a$", True), ("/ab", "/a$", False),
    ("/x/1/y/2", "/x/*/y/*", True), ("/x/1", "/x/*/y", False), ("/anything", "*", True), ("/a\nb", "/*b", True), ("/a+b", "/a+b", True), ("/aab", "/a+b", False),
]


def test_patterns(spark):
    for path, pattern, want in PATTERNS:
        assert R.matches(path, pattern) == want, (path, pattern)
    rows = spark.createDataFrame([(i, p, R.regex_of(q)) for i, (p, q, _) in enumerate(PATTERNS)], "i int, p string, r string")
    assert [r[0] for r in rows.orderBy("i").select(F.regexp_like("p", "r")).collect()] == [w for _, _, w in PATTERNS]


def test_verdict_is_the_same_everywhere(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /a/b/c/d\nAllow: /z\nDisallow: /z\nDisallow: /end$"
    paths = ["/a", "/a/b", "/a/b/c/d/e", "/z", "/", "/end", "/end/x", "", "/b"]
    urls = spark.createDataFrame([(f"https://h.example{p}",) for p in paths] + [("https://unknown.example/a",)], "url string")
    got = {r["url"]: r["allowed"] for r in R.allowed_urls(urls, R.rules_frame(spark, {"h.example": text})).collect()}
    for p in paths:
        assert got[f"https://h.example{p}"] == allowed_by(R.parse(text), p or "/"), p
    assert got["https://h.example/z"] is False and got["https://h.example/a/b"] is True and got["https://unknown.example/a"]


def test_rules_of_many_hosts(spark):
    texts = {"a": TEXT, "b": "", "c": "User-agent: *\nAllow: /x*y$"}
    frame = spark.createDataFrame([*texts.items(), ("d", None)], "host string, text string")
    got = {r["host"]: r for r in R.read_rules(frame).collect()}
    assert {h: got[h] for h in texts} == {r["host"]: r for r in R.rules_frame(spark, texts).collect()} and got["d"]["disallow"] == []


def test_headers(spark):
    pairs = spark.createDataFrame([([("Content-Type", "text/html"), ("X-A", "1"), ("x-a", "2")],)], "h array<struct<name:string,value:string>>")
    assert pairs.select(D.headers_json(D.header_map(F.col("h")))).first()[0] == '{"content-type":"text/html","x-a":"1"}'


def test_header_columns(spark):
    rows = ['{"content-length":"12abc"}', '{"content-length":"abc"}', '{"content-length":"-7"}', "{}", None, '{"last-modified":"Mon, 02 Jan 2006 15:04:05 GMT","x-cache":"HIT"}', '{"last-modified":"2024-02-03 04:05:06"}']
    got = D.with_header_columns(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, response_http_headers string")).orderBy("i").collect()
    assert [r["content_length"] for r in got] == [12, 0, -7, None, None, None, None]
    assert got[5]["last_modified"] is None and got[5]["x_cache"] == "HIT" and got[6]["last_modified"].year == 2024


def test_is_html_and_millis(values):
    assert values(D.is_html, ["text/html; charset=x", "application/xhtml+xml", "Text/HTML", "application/json"]) == [True, True, False, False]
    assert values(D.millis, [0.0019, -0.0019, 1.5], "double") == [1, -1, 1500]
