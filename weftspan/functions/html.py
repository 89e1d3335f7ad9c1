"""Page analysis: title, meta tags, canonical URL, links and hash of an HTML page.

parse_page() reads any page with the standard library's tokenizer; it doesn't repair trees, so
misnested markup may differ from a browser's reading. The Column functions below it read flat
markup inside the JVM; tests hold both against each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import find_package
from .urls import DEFAULT_SCHEMES, resolve

ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'
#: A segment's characters in a path that is the same resolved by either way: no escapes, dots as a segment, queries or colons.
_CHARS = r"[[A-Za-z0-9,._-][^\x00-\x7F]]"
_FLAT = rf'(?-i:<a href="/(?:(?!\.{{1,2}}/){_CHARS}++/)*+(?!\.{{1,2}}"){_CHARS}*+">)[ [^<&\p{{Cc}}\p{{Z}}]]*+(?-i:</a>)'
#: Elements whose content is no markup.
_RAW = "script|style|title|textarea|iframe|noembed|noframes|noscript|xmp|plaintext"
_ATTRIBUTE = r"""[ \t\n\r\f]++[a-z][a-z0-9_:.-]*+(?:="[^"<>]*+"|='[^'<>]*+')?+"""
#: Whole pages that a tokenizer surely splits as these words say, with no anchor but flat ones outside of all else. Java's syntax; nothing backtracks.
COVERED = "(?i)\\A(?:" + "|".join((
    "[^<]++",
    _FLAT,
    "<title>[^<]*+</title>",
    r"<!doctype [a-z0-9 ]*+>",
    "<!--[^<>]*-->",
    rf"<(script|style)(?:{_ATTRIBUTE})*+>(?:[^<]++|<(?!/?script|/?style|!--|a))*+</\1>",
    rf"</(?!(?:{_RAW})(?![a-z0-9-]))[a-z][a-z0-9-]*+>",
    rf"<(?!(?:a|{_RAW})(?![a-z0-9-]))[a-z][a-z0-9-]*+(?:{_ATTRIBUTE})*+[ \t\n\r\f]*+/?>",
)) + ")*+\\z"
#: URLs of pages whose origin is the same by either way.
PLAIN_ORIGIN = r"^https?://[A-Za-z0-9.-]+(:[0-9]{1,4})?([/?#]|$)"
PARSED = "title string, meta_description string, meta_robots string, canonical_url string, content_hash string, links array<struct<url:string,anchor_text:string,rel_attribute:string,is_external:boolean>>"


def allowed(href: str, schemes: Sequence[str]) -> bool:
    """urls.href_gate() for one string."""
    if "://" in href:
        return href.startswith(tuple(schemes))
    if ":" in href and href[:1] not in ("/", "?", "#"):
        return href.startswith(tuple(s.removesuffix("://") for s in schemes))
    return True


class _Reader(HTMLParser):
    """Collects what a page says of itself, and its anchors in the order they begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.facts = {"title": "", "description": "", "robots": "", "canonical": ""}
        self.anchors: list[tuple[str, str, list[str]]] = []
        self.open: list[str] | None = None
        self.title: str | None = None
        self.text = ""

    def _flush(self) -> None:
        if self.open is not None and self.text.strip():
            self.open.append(self.text.strip())
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.title is not None:
            self.title += self.get_starttag_text() or ""
            return
        self._flush()
        at = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.title = ""
        elif tag == "meta" and at.get("name", "").lower() in ("description", "robots"):
            self.facts[at["name"].lower()] = at.get("content", "")
        elif tag == "link" and at.get("rel", "").lower() == "canonical" and at.get("href"):
            self.facts["canonical"] = at["href"]
        elif tag == "a":
            self.open = []
            self.anchors.append((at.get("href", ""), at.get("rel", ""), self.open))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            if self.title:
                self.facts["title"] = self.title.strip()
            self.title = None
            return
        if self.title is not None:
            self.title += f"</{tag}>"
            return
        self._flush()
        if tag == "a":
            self.open = None

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title += data
        elif self.open is not None:
            self.text += data

    def close(self) -> None:
        super().close()
        self._flush()
        if self.title:
            self.facts["title"] = self.title.strip()
            self.title = None


def parse_page(base: str, html: str | bytes | None, schemes: Sequence[str] = DEFAULT_SCHEMES) -> dict:
    """A row of PARSED; the hash is of the raw bytes."""
    raw = (html or "").encode() if not isinstance(html, bytes) else html
    reader = _Reader()
    reader.feed(raw.decode("utf-8", "replace"))
    reader.close()
    links = []
    host = (resolve(base, "/") or "").partition("://")[2].partition("/")[0].rpartition("@")[2]
    for href, rel, text in reader.anchors:
        if not href or href.startswith(("#", "javascript:")) or not allowed(href, schemes):
            continue
        url = resolve(base, href)
        if url is None or not allowed(url, schemes):
            continue
        there = url.partition("://")[2].partition("/")[0].partition("?")[0].partition("#")[0].rpartition("@")[2]
        links.append({"url": url, "anchor_text": " ".join(text).strip(), "rel_attribute": rel, "is_external": there != host})
    f = reader.facts
    return {"title": f["title"], "meta_description": f["description"], "meta_robots": f["robots"], "canonical_url": (resolve(base, f["canonical"]) or "") if f["canonical"] else "", "content_hash": hashlib.sha256(raw).hexdigest(), "links": links}


def parse_pages(pages: DataFrame, schemes: Sequence[str] = DEFAULT_SCHEMES, url: str = "url", html: str = "html") -> DataFrame:
    """pages with the columns of PARSED instead of the html, in Arrow batches."""
    find_package(pages.sparkSession)
    kept = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            read = [parse_page(u, h, schemes) for u, h in zip(rows[url], rows[html], strict=True)]
            yield pd.concat([rows[kept].reset_index(drop=True), pd.DataFrame(read, columns=[c.split()[0] for c in PARSED.split(", ")])], axis=1)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    return pages.mapInPandas(run, f"{shape}, {PARSED}")


@F.udtf(returnType="pos int, target_url string, anchor_text string, rel_attribute string, is_external boolean")
class ExtractLinks:
    """extract_links(url, html) for SQL: a row for each link of a page, in document order; none for null."""

    def eval(self, url: str, html: str):
        if url is None or html is None:
            return
        for k, link in enumerate(parse_page(url, html)["links"]):
            yield k, link["url"], link["anchor_text"], link["rel_attribute"], link["is_external"]


def content_hash(html: Column) -> Column:
    """Lower-case hex SHA-256 of the bytes."""
    return F.sha2(html, 256)


def unescaped(text: Column) -> Column:
    """Text with the basic character references decoded; the ampersand's may lack its semicolon, as HTML allows."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return F.regexp_replace(text, "&amp;?", "&")


def title(html: Column) -> Column:
    """The last title of flat markup that isn't empty."""
    found = F.filter(F.regexp_extract_all(html, F.lit("(?is)<title>(.*?)</title>"), F.lit(1)), lambda t: t != "")
    return F.trim(unescaped(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))))


def titles(pages: DataFrame) -> DataFrame:
    """page_id and title of every page: by the expression above where it surely reads what parse_page() does, else by that; '' for null pages."""
    plain = pages.select("page_id", "html")
    odd = r"(?is)<title>[^<]*&(?!(?:lt|gt|quot|apos|#39|amp);)"
    flat = F.coalesce((F.col("html").rlike(COVERED) & ~F.col("html").rlike(odd)) | ~F.col("html").rlike("(?i)<title"), F.lit(True))
    rest = parse_pages(plain.where(~flat).withColumn("url", F.lit("http://x/"))).select("page_id", "title")
    return plain.where(flat).select("page_id", F.coalesce(title(F.col("html")), F.lit("")).alias("title")).unionByName(rest)


def covered(html: Column, url: Column) -> Column:
    """Whether flat_links() surely reads what parse_page() does; never null."""
    return F.coalesce(html.rlike(COVERED) & url.rlike(PLAIN_ORIGIN), F.lit(False))


def flat_links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href and anchor_text of each flat anchor, in document order."""
    # the page is searched once; the parts come from each short match
    part = lambda m: F.struct(F.regexp_extract(m, ANCHOR, 1).alias("href"), F.regexp_extract(m, ANCHOR, 2).alias("text"))
    anchors = F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0)), part)
    found = pages.select("page_id", "url", F.posexplode(anchors).alias("pos", "link"))
    return found.select("page_id", "url", "pos", F.col("link.href").alias("href"), F.trim(F.col("link.text")).alias("anchor_text"))
