"""The link graph: nodes by URL, edges by pair of URLs.

A node's id is a hash of its URL, so that nothing needs a global counter; ids carry no meaning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U


def node_id(url: Column) -> Column:
    return F.xxhash64(url)


def links_of_pages(pages: DataFrame, schemes: Sequence[str] = U.DEFAULT_SCHEMES) -> DataFrame:
    """page_id, pos, source_url, target_url, anchor_text, link_type and rel_attribute of every anchor of pages with a URL.

    Pages of flat anchors with rooted paths stay inside the JVM; all others that may have an anchor are parsed.
    """
    pages = pages.select("page_id", "url", "html").where("url IS NOT NULL AND html IS NOT NULL")
    flat = H.covered(F.col("html"), F.col("url"))
    parsed = H.parse_pages(pages.where(~flat & F.col("html").rlike("(?i)<a[^a-z>]")), schemes)
    found = H.flat_links(pages.where(flat)).where(~U.ignored_href(F.col("href")) & U.href_gate(F.col("href"), schemes))
    found = found.withColumn("target_url", U.resolve_rooted(F.col("url"), F.col("href"))).where(U.href_gate(F.col("target_url"), schemes))
    found = found.select("page_id", "pos", F.col("url").alias("source_url"), "target_url", "anchor_text", U.link_type(F.col("target_url"), F.col("url")).alias("link_type"), F.lit("").alias("rel_attribute"))
    return found.unionByName(links_of_parsed(parsed, keep=["page_id"]))


def links_of_parsed(parsed: DataFrame, source: str = "url", save_external: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """The links of html.parse_pages()'s rows, with its columns `keep`; source: the column with the URL that answered, after redirects."""
    rows = parsed.select(*keep, F.col(source).alias("source_url"), F.posexplode("links").alias("pos", "link"))
    rows = rows.select(*keep, "source_url", "pos", F.col("link.url").alias("target_url"), "link.anchor_text", F.when(F.col("link.is_external"), "external").otherwise("internal").alias("link_type"), "link.rel_attribute")
    return rows if save_external else rows.where("link_type <> 'external'")


def first_edges(links: DataFrame, order: Sequence[str], source: str = "source_url", target: str = "target_url") -> DataFrame:
    """One edge for each pair of URLs: the first in `order`. Summed up on the map side, so repeats don't shuffle."""
    rest = [c for c in links.columns if c not in (source, target)]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return links.groupBy(source, target).agg(first.alias("__first")).select(source, target, *[F.col(f"__first.{c}").alias(c) for c in rest])


def endpoints(links: DataFrame) -> DataFrame:
    """Distinct URLs at either end."""
    return links.select(F.explode(F.array("source_url", "target_url")).alias("url")).distinct()


def unseen(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """URLs that no page has."""
    return urls.join(pages.select("url"), "url", "left_anti")


def with_nodes(pages: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """pages and, as 'discovered', the ends of links that it lacks."""
    new = unseen(endpoints(links), pages).select("url", F.lit("discovered").alias("status"), now.alias("added_at"), node_id(F.col("url")).alias("id"), F.lit(0).alias("retry_count"))
    return pages.unionByName(new.select(*[c for c in new.columns if c in pages.columns]), allowMissingColumns=True)


def relations(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges by the ids of pages; ends that no page has are dropped. A URL of several pages stands for one node, with the least of their ids, so an edge never becomes two."""
    ends = lambda n: pages.groupBy(F.col("url").alias(f"{n}_url")).agg(F.min("id").alias(f"{n}_page_id"))
    return links.join(ends("source"), "source_url").join(ends("target"), "target_url").drop("source_url", "target_url")


def save_edges(edges: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """edges and those of `new` that it lacks, the first of each pair."""
    pair = ["source_url", "target_url"]
    fresh = first_edges(new, order).join(edges.select(*pair), pair, "left_anti")
    return edges.unionByName(fresh.select(*[c for c in fresh.columns if c in edges.columns]), allowMissingColumns=True)


def links_view(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Relations by ids as URLs: two inner joins with the distinct nodes, whichever pages share one."""
    ends = lambda n: pages.select(F.col("id").alias(f"{n}_page_id"), F.col("url").alias(f"{n}_url")).distinct()
    out = edges.join(ends("source"), "source_page_id").join(ends("target"), "target_page_id")
    return out.select("source_url", "target_url", *[c for c in edges.columns if c not in ("source_page_id", "target_page_id")])


def foreign_key_violations(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Relations one of whose ends is no page."""
    ids = pages.select("id")
    out = [edges.join(ids.withColumnRenamed("id", c), c, "left_anti").withColumn("missing", F.lit(c)) for c in ("source_page_id", "target_page_id")]
    return out[0].unionByName(out[1])


def duplicate_pairs(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_url", "target_url").count().where("count > 1")


def inbound(links: DataFrame) -> DataFrame:
    """Linking pages and links by target."""
    return links.groupBy("target_url").agg(F.countDistinct("source_url").alias("linking_pages"), F.count("*").alias("links"))


def outbound(links: DataFrame) -> DataFrame:
    """Links, distinct targets and external links by source."""
    return links.groupBy("source_url").agg(F.count("*").alias("links"), F.countDistinct("target_url").alias("targets"), F.count_if(F.col("link_type") == "external").alias("external_links"))


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row of each key, with its place among all of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
