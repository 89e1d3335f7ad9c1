from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftspan.functions import urls as U
from weftspan.functions.html import allowed


def test_parts(values):
    rows = ["https://a.example:8080/x/y?q=1#f", "HTTP://u:p@b.example", "nothing", None, "http://c.example/a%20b+c"]
    assert values(U.scheme, rows) == ["https", "http", "", None, "http"]
    assert values(U.authority, rows) == ["a.example:8080", "b.example", "", None, "c.example"]
    assert values(U.path, rows)[:2] == ["/x/y", "/"]
    assert values(U.path, rows)[4] == "/a b+c"
    assert values(U.origin, rows)[1] == "http://b.example"


GATE = [
    ("https://a/", True), ("http://a/", True), ("ftp://a/", False), ("tel:+1", False), ("mailto:a@b", False), ("/rel", True), ("rel", True), ("?q=a:b", True), ("/a:b", True), ("#a:b", True),
    ("page:2", False), ("/go?u=https://x", False), ("HTTP://a/", False), ("http:foo", True), ("httpfoo:bar", True), ("//a/b", True), ("", True),
]


def test_href_gate(values):
    assert values(U.href_gate, [h for h, _ in GATE]) == [v for _, v in GATE]
    assert [allowed(h, U.DEFAULT_SCHEMES) for h, _ in GATE] == [v for _, v in GATE]
    assert values(lambda c: U.href_gate(c, ["ftp://"]), ["ftp://a", "http://a", "ftp:x"]) == [True, False, True]


def test_ignored(values):
    assert values(U.ignored_href, ["", "#x", "javascript:void(0)", "JavaScript:x", "/a"]) == [True, True, True, False, False]


def test_schemes(values):
    rows = ["https://a", "http://a", "ftp://a", "a"]
    assert values(lambda c: U.scheme_gate(c, []), rows) == [True, True, False, False]
    assert values(lambda c: U.scheme_gate(c, ["ftp://"]), rows) == [False, False, True, False]


@pytest.mark.parametrize(
    ("seeds", "external", "url", "want"),
    [
        (["https://a.example/x/y"], False, "https://a.example/other", True),
        (["https://a.example"], False, "https://a.example", True),
        (["https://a.example"], False, "https://a.example?x=1", False),
        (["https://a.example"], False, "http://a.example/", False),
        (["https://a.example"], False, "https://a.example:8443/", False),
        (["https://a.example:8443"], False, "https://a.example:8443/", True),
        (["https://a.example"], False, "https://sub.a.example/", False),
        (["https://a.example"], False, "https://a.example.evil/", False),
        (["https://a.example", "https://b.example/z"], False, "https://b.example/", True),
        ([], False, "https://a.example/", False),
        ([], True, "https://a.example/", True),
        ([], True, "ftp://a.example/", False),
    ],
)
def test_host_scope(values, seeds, external, url, want):
    assert values(lambda c: U.host_scope(c, seeds, external), [url]) == [want]


@pytest.mark.parametrize(
    ("include", "exclude", "url", "want"),
    [
        ([], [], "https://a/x", True),
        ([r"/articles/"], [], "https://a/articles/1", True),
        ([r"/articles/"], [], "https://a/other", False),
        ([r"^https://a/x", r"\d+$"], [], "https://a/y/7", True),
        ([], [r"\.pdf$"], "https://a/x.pdf", False),
        ([r"/a"], [r"/a"], "https://x/a", False),
        ([r"["], [], "https://x/a", False),
        ([], [r"["], "https://x/a", True),
        ([r"(?=x)x"], [], "https://x/a", False),
        ([r"(a)\1"], [], "https://aa/", False),
    ],
)
def test_patterns(values, include, exclude, url, want):
    assert values(lambda c: U.pattern_scope(c, include, exclude), [url]) == [want]


def test_host_outranks_include(values):
    scope = lambda c: U.crawl_scope(c, ["https://a.example"], [r"b\.example"], [])
    assert values(scope, ["https://b.example/", "https://a.example/b.example"]) == [False, True]


def test_seed_origins():
    assert U.seed_origins(["https://a.example/x?y", "https://a.example", "http://u@b.example:81/z", "https://[bad"]) == ["https://a.example", "http://b.example:81"]


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/a", "https://h.example/a"), ("b", "https://h.example/d/b"), ("../b", "https://h.example/b"), ("./", "https://h.example/d/"), ("?q=1", "https://h.example/d/p?q=1"), ("//o.example/x", "https://o.example/x"),
        ("http://o.example", "http://o.example"), ("/é", "https://h.example/%C3%A9"), ("/a,b", "https://h.example/a,b"), ("/é,b", "https://h.example/%C3%A9,b"), ("/a b", "https://h.example/a%20b"), ("/%zz", None), ("/\x01", None),
        ("/a%2Fb", "https://h.example/a%2Fb"), ("/(x)", "https://h.example/(x)"),
    ],
)
def test_resolve(href, want):
    assert U.resolve("https://h.example/d/p?z=1#f", href) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("abz09/.,_~é ñß"), min_size=0, max_size=12), min_size=1, max_size=8))
def test_rooted_resolution_is_the_general_one(spark, names):
    from pyspark.sql import functions as F

    # paths from the root without dots that climb, empty parts or spaces
    hrefs = ["/x" + n.replace("./", "").replace("..", "").replace("//", "/").replace(" ", "").rstrip("./") for n in names]
    hrefs = [h for h in hrefs if "/." not in h and "//" not in h and not ("~" in h and not h.isascii())]
    if hrefs:
        rows = spark.createDataFrame([("https://h.example/p", h) for h in hrefs], "b string, h string").select("h", U.resolve_rooted(F.col("b"), F.col("h")).alias("u"), U.resolve_udf("b", "h").alias("g")).collect()
        assert [r["u"] for r in rows] == [U.resolve("https://h.example/p", r["h"]) for r in rows] == [r["g"] for r in rows]
