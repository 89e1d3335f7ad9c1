"""Queries on pages that share URLs under ids of their own, against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from weftspan.operators import graph as G
from weftspan.operators import lifecycle as L
from weftspan.plans.catalog import ORACLES, QUERIES

from .test_queries import DIR, plain

NAMES = ["links_view", "enqueue_without_nulls", "update_status", "save_error", "save_error_repeats", "save_skipped", "save_result"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Every URL on three pages: in other states by id, one with the markup of another page, one a copy."""
    out = str(tmp_path_factory.mktemp("repeated"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW p AS SELECT * FROM '{DIR}/pages.parquet'")
    con.execute(f"COPY (SELECT * FROM p UNION ALL SELECT p.page_id + 51, p.url, q.html FROM p JOIN p q ON q.page_id = 49 - p.page_id UNION ALL SELECT page_id + 102, url, html FROM p) TO '{out}/pages.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{out}/pages.parquet'")
    return out, con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, repeated, name):
    out, con = repeated
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, out)
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_an_edge_between_urls_of_several_pages_stays_one(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "u")], "source_url string, target_url string, anchor_text string")
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "b")], "id long, url string")
    assert sorted(tuple(r) for r in G.relations(edges, pages).select("source_page_id", "target_page_id").collect()) == [(1, 3), (3, 1)]
    assert sorted(tuple(r) for r in G.links_view(G.relations(edges, pages), pages).collect()) == [("a", "b", "t"), ("b", "a", "u")]


def test_enqueue_by_id(spark):
    shape = "id long, url string, status string, added_at long, retry_count int"
    have = spark.createDataFrame([(1, "a", "discovered", 1, 0), (2, "a", "discovered", 1, 0), (3, None, "completed", 1, 0)], shape)
    asked = spark.createDataFrame([(1, "a"), (3, "c"), (4, "a"), (4, "a"), (5, "a"), (6, None), (None, "d")], "id long, url string")
    got = L.add_to_queue(have, asked, F.lit(9), key="id")
    assert got.dtypes == have.dtypes
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "pending", 9, 0), (2, "a", "discovered", 1, 0), (3, None, "completed", 1, 0), (4, "a", "pending", 9, 0), (5, "a", "pending", 9, 0)]
    by_url = L.add_to_queue(have, asked.select("url"), F.lit(9))  # pages without a url stay as they are here, too
    assert sorted((r["url"] or "", r["status"]) for r in by_url.collect()) == [("", "completed"), ("a", "pending"), ("a", "pending"), ("c", "pending"), ("d", "pending")]
