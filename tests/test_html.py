from __future__ import annotations

import hashlib

from weftspan.functions import html as H
from weftspan.functions.html import parse_page

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><meta NAME="Description" content="what it is">
<meta name="robots" content="noindex"><link rel="Canonical" href="/canon"><link rel="canonical alternate" href="/no"></head><body>
<a href="/one">One</a><a href="two" rel="NoFollow me">Two <b>bold <i>deep</i></b> end</a><a href="#frag">f</a><a href="javascript:x()">j</a>
<a href="https://other.example/x">O</a><a href="mailto:a@b.example">m</a><a href="">e</a><a name="n">no href</a><a href="https://h.example:8443/p">port</a></body></html>"""


def test_full_page():
    got = parse_page("https://h.example/d/p", PAGE)
    assert (got["title"], got["meta_description"], got["meta_robots"], got["canonical_url"]) == ("A & B", "what it is", "noindex", "https://h.example/canon")
    assert got["content_hash"] == hashlib.sha256(PAGE.encode()).hexdigest()
    links = [(x["url"], x["anchor_text"], x["rel_attribute"], x["is_external"]) for x in got["links"]]
    assert links == [
        ("https://h.example/one", "One", "", False),
        ("https://h.example/d/two", "Two bold deep end", "NoFollow me", False),
        ("https://other.example/x", "O", "", True),
        ("https://h.example:8443/p", "port", "", True),
    ]


def test_empty_and_odd_pages():
    for page in ("", None, "plain", "<", "<a", "<title>", "<title></title>"):
        got = parse_page("https://h.example/", page)
        assert got["links"] == [] and got["title"] in ("",) and got["canonical_url"] == ""


def test_last_title_and_meta_win():
    got = parse_page("https://h.example/", '<title>a</title><title>b <b>x</b></title><meta name=description content=x><meta name=description content="">')
    assert got["title"] == "b <b>x</b>" and got["meta_description"] == ""


def test_schemes_and_base():
    page = '<base href="https://base.example/"><a href="tel:1">t</a><a href="ftp://f.example/">f</a><a href="r">r</a><a href="chrome-extension://x">c</a><a href="/go?u=https://x">g</a>'
    assert [x["url"] for x in parse_page("https://h.example/", page)["links"]] == ["https://h.example/r"]
    assert [x["url"] for x in parse_page("https://h.example/", page, ["ftp://"])["links"]] == ["ftp://f.example/"]


def test_nested_anchor_ends_the_first():
    got = parse_page("https://h.example/", '<a href="/1">x<a href="/2">y</a>z</a>')
    assert [(x["url"], x["anchor_text"]) for x in got["links"]] == [("https://h.example/1", "x"), ("https://h.example/2", "y")]


def test_flat_reading_is_the_general_one(spark):
    from pyspark.sql import functions as F

    from weftspan.operators.graph import links_of_pages, links_of_parsed

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    general = links_of_parsed(H.parse_pages(pages.select("url", "html")))
    flat = links_of_pages(pages)
    cols = ["source_url", "pos", "target_url", "anchor_text", "link_type", "rel_attribute"]
    assert general.select(cols).exceptAll(flat.select(cols)).count() == 0 == flat.select(cols).exceptAll(general.select(cols)).count()
    titles = H.parse_pages(pages).select("page_id", "title").exceptAll(pages.select("page_id", H.title(F.col("html")).alias("title")))
    assert titles.count() == 0


def test_every_anchor_of_any_page(spark):
    from weftspan.operators.graph import links_of_pages, links_of_parsed

    flat = '<p>x</p><a href="/one">One</a>'
    odd = [
        PAGE, '<a class="c" href="/c" rel="nofollow">C</a>', "<a href='/s'>S</a>", '<A HREF="/u">U</A>', '<a href="/n"><b>N</b> m</a>', '<a href="rel">r</a>', '<a href="https://other.example/x?y">o</a>', '<a href="//third.example/">t</a>', '<a href="/e&amp;f">a &lt; b</a>',
        '<a href="/q?a=1#f">q</a>', '<a href="/x/../y">d</a>', '<a href="/..">d</a>', '<a href="/.hidden/a.b">h</a>', '<a href="/ä b">sp</a>', '<a href="/ä/~x">t</a>', '<a href="/ü">\n ü \xa0</a>', '<a href="">e</a><a href="#f">f</a><a href="mailto:a@b.example">m</a>', '<a\nhref="/nl">nl</a>', '<img alt=\'<a href="/no">no</a>\'>',
        '<!-- <a href="/no">no</a> -->', '<script>"<a href=\\"/no\\">"; x = \'<a href="/no">no</a>\'</script>', '<title><a href="/no">no</a></title>', '<a href="/1">x<a href="/2">y</a>z</a>', '<a href="/open">open', '<textarea><a href="/t">t</a></textarea>', "<a", "", None, "no anchor < here", '<a href="/a//b">s</a>', '<a href="/%zz">z</a>',
    ]
    rows = [(k, f"https://h.example/d/{k}", p if p is None or k % 2 else f"{flat}{p}") for k, p in enumerate([*odd, *odd[1:]])]
    rows += [(1000, "https://user:pw@h.example:80/", flat), (1001, "http://h.example:99999/", flat), (1002, None, PAGE), (1003, "https://h.example", flat)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = links_of_pages(pages)
    want = links_of_parsed(H.parse_pages(pages.where("url IS NOT NULL")), keep=["page_id"])
    cols = ["page_id", "pos", "source_url", "target_url", "anchor_text", "link_type", "rel_attribute"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert ("https://h.example/c", "nofollow") in {(r["target_url"], r["rel_attribute"]) for r in got.collect()} and {r["link_type"] for r in got.collect()} == {"internal", "external"}


def test_given_pages_stay_inside_the_jvm(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert pages.where(~H.covered(F.col("html"), F.col("url"))).count() == 0


def test_null_pages_through_spark(spark):
    rows = spark.createDataFrame([(1, "https://h.example/", None), (2, "https://h.example/2", "<title>x</title>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["title"] for r in H.parse_pages(rows).collect()} == {1: "", 2: "x"}
