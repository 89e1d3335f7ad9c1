from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftspan.operators import analytics as A
from weftspan.operators import graph as G
from weftspan.operators import lifecycle as L
from weftspan.sources import schemas as S

SHAPE = "id long, url string, status string, added_at long, processing_started_at long, retry_count int, last_error_type string, last_error_message string, status_code int, content_hash string"


def pages(spark, *rows):
    full = [{"id": i, "url": r[0], "status": r[1], "added_at": 1, "retry_count": 0, **(r[2] if len(r) > 2 else {})} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(d.get(c.split()[0]) for c in SHAPE.split(", ")) for d in full], SHAPE)


def by_url(df):
    return {r["url"]: r for r in df.collect()}


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_promotion(spark):
    have = pages(spark, *[(s, s) for s in S.STATUSES])
    got = by_url(L.add_to_queue(have, urls(spark, *S.STATUSES, "new", "new"), F.lit(9)))
    assert {u: r["status"] for u, r in got.items()} == {**{s: s for s in S.STATUSES}, "discovered": "pending", "new": "pending"}
    assert {u for u, r in got.items() if r["added_at"] == 9} == {"discovered", "new"} and got["new"]["retry_count"] == 0


def test_claims_are_disjoint_and_in_order(spark):
    have = pages(spark, *[(f"u{i}", "pending", {"added_at": i % 3}) for i in range(9)])
    seen = []
    for k in range(4):
        have, mine = L.claim_next(have, 3, F.lit(k))
        seen.append(sorted(r["url"] for r in mine.collect()))
        have = spark.createDataFrame(have.collect(), SHAPE)
    assert seen == [["u0", "u3", "u6"], ["u1", "u4", "u7"], ["u2", "u5", "u8"], []]
    assert A.status_counts(have).first().asDict() == {"pending": 0, "processing": 9, "completed": 0, "error": 0}


def test_results_errors_skips(spark):
    have = pages(spark, ("a", "processing", {"retry_count": 2, "last_error_type": "old", "status_code": 1}), ("b", "processing"), ("c", "processing"))
    done = by_url(L.save_results(have, spark.createDataFrame([("a", None)], "url string, status_code int")))
    assert done["a"]["status"] == "completed" and done["a"]["status_code"] is None and done["a"]["last_error_type"] == "old" and done["a"]["retry_count"] == 2 and done["b"]["status"] == "processing"
    bad = by_url(L.save_errors(have, spark.createDataFrame([("a", "network_error", "m")], "url string, error_type string, error_message string")))
    assert (bad["a"]["status"], bad["a"]["retry_count"], bad["a"]["last_error_message"]) == ("error", 3, "m")
    skip = by_url(L.save_skipped(have, spark.createDataFrame([("b", "robots", "m")], "url string, reason string, message string")))
    assert (skip["b"]["status"], skip["b"]["retry_count"], skip["b"]["last_error_type"]) == ("skipped", 0, "robots")


def test_retries(spark):
    have = pages(
        spark, ("a", "error", {"last_error_type": "network_timeout", "retry_count": 1, "processing_started_at": 5}), ("b", "error", {"last_error_type": "network_error"}),
        ("c", "error", {"last_error_type": "server_error_5xx", "retry_count": 3}), ("d", "error", {"last_error_type": "connection_refused"}), ("e", "completed", {"last_error_type": "network_timeout"}),
    )
    assert [r["url"] for r in L.retryable(have, 3).collect()] == ["d", "a"]
    got = by_url(L.requeue_errors(have, 3))
    assert {u for u, r in got.items() if r["status"] == "pending"} == {"a", "d"}
    assert got["a"]["processing_started_at"] is None and got["a"]["added_at"] == 1 and got["a"]["last_error_type"] == "network_timeout"


def test_stale(spark):
    have = pages(spark, ("a", "processing"), ("b", "processing", {"processing_started_at": 4}), ("c", "processing", {"processing_started_at": 6}), ("d", "completed"))
    assert {u: r["status"] for u, r in by_url(L.reset_stale(have, F.lit(5))).items()} == {"a": "pending", "b": "pending", "c": "processing", "d": "completed"}
    assert [r["url"] for r in L.processing(have).collect()] == ["c", "b", "a"]


def test_meta_and_status(spark):
    meta = spark.createDataFrame([], S.META)
    for k, (key, value) in enumerate([("a", "1"), ("b", "2"), ("a", "3")]):
        meta = L.set_meta(meta, key, value, k)
    assert (L.get_meta(meta, "a"), L.get_meta(meta, "b"), L.get_meta(meta, "z")) == ("3", "2", "")
    got = by_url(L.url_status(pages(spark, ("a", "error")), urls(spark, "a", "z")))
    assert (got["a"]["status"], got["a"]["known"], got["z"]["status"], got["z"]["known"]) == ("error", True, "", False)


def test_empty_tables(spark):
    none = pages(spark)
    assert A.status_counts(none).first().asDict() == dict.fromkeys(("pending", "processing", "completed", "error"), 0)
    assert A.has_queued(none).first()[0] is False and A.queue_status(none).count() == 0
    assert L.add_to_queue(none, urls(spark), F.lit(1)).count() == 0


def test_duplicates_leave_out_pages_without_a_body(spark):
    have = pages(spark, ("a", "completed", {"content_hash": ""}), ("b", "completed", {"content_hash": ""}), ("c", "completed", {"content_hash": "h"}), ("d", "completed", {"content_hash": "h"}), ("e", "completed"))
    assert [tuple(r) for r in A.duplicate_content(have).collect()] == [("h", 2, "c")]


def test_frontier(spark):
    have = pages(spark, ("https://a/1", "discovered"), ("https://a/2", "completed"), ("https://a/3", "pending"))
    links = spark.createDataFrame([("https://a/", f"https://a/{i}", "internal") for i in (1, 1, 2, 3, 4)] + [("https://a/", "https://b/", "external")], "source_url string, target_url string, link_type string")
    assert sorted(r["url"] for r in L.frontier(links, have, F.lit(True)).collect()) == ["https://a/1", "https://a/4"]


def test_edges(spark):
    shape = "source_url string, target_url string, anchor_text string, pos int"
    old = spark.createDataFrame([("a", "b", "kept", 0)], shape)
    new = spark.createDataFrame([("a", "b", "late", 0), ("a", "c", "second", 5), ("a", "c", "first", 2), ("a", "a", "self", 1)], shape)
    got = {(r["source_url"], r["target_url"]): r["anchor_text"] for r in G.save_edges(old, new, ["pos"]).collect()}
    assert got == {("a", "b"): "kept", ("a", "c"): "first", ("a", "a"): "self"}
    nodes = G.with_nodes(pages(spark, ("a", "completed")), new, F.lit(7))
    assert {r["url"]: r["status"] for r in nodes.collect()} == {"a": "completed", "b": "discovered", "c": "discovered"}
    assert G.duplicate_pairs(new).count() == 1 and G.first_seen(new, ["source_url", "target_url"], ["pos"]).count() == 3


def test_foreign_keys(spark):
    edges = spark.createDataFrame([(1, 2), (1, 9), (8, 9)], "source_page_id long, target_page_id long")
    assert sorted((r["missing"], r["target_page_id"]) for r in G.foreign_key_violations(edges, spark.createDataFrame([(1,), (2,)], "id long")).collect()) == [("source_page_id", 9), ("target_page_id", 9), ("target_page_id", 9)]


def test_upgrade(spark):
    old = spark.createDataFrame([("https://a/", "pending")], "url string, status string")
    new = S.upgrade_pages(old)
    assert [f.name for f in new.schema] == [c.split()[0] for c in S.PAGES.split(", ")] and new.first()["retry_count"] == 0
    with pytest.raises(ValueError):
        S.upgrade_pages(spark.createDataFrame([("u", "odd")], "url string, status string"))
    with pytest.raises(ValueError):
        S.upgrade_pages(spark.createDataFrame([("u",)], "url string"))


def test_store(spark, tmp_path):
    from weftspan.sources.store import Store

    store = Store(spark, str(tmp_path))
    assert store.read("t") is None
    for k in range(4):
        store.write("t", spark.range(k + 1))
    (tmp_path / "t" / "v00000009").mkdir()  # a write that died
    assert store.read("t").count() == 4 and store.versions("t") == [1, 2, 3, 4]
    store.prune()
    assert store.versions("t") == [3, 4]


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    from weftspan.sources.store import DELTAS, Store

    store = Store(spark, str(tmp_path))
    store.commit({"pages": spark.range(3)}, {"links": spark.range(2)})
    bad = spark.range(1).selectExpr("raise_error('no') AS id")
    with pytest.raises(Exception, match="no"):
        store.commit({"pages": spark.range(9)}, {"links": bad})  # pages were written, and don't count
    assert store.read("pages").count() == 3 and store.read("links").count() == 2
    store.commit({"pages": spark.range(4)}, {"links": spark.range(5)})
    assert store.read("pages").count() == 4 and store.read("links").count() == 7 and len(store.current()["links"]) == 2
    for _ in range(DELTAS):
        store.commit(more={"links": spark.range(1)})
    assert store.read("links").count() == 7 + DELTAS and len(store.current()["links"]) < DELTAS
    store.prune()
    assert store.read("links").count() == 7 + DELTAS and store.read("pages").count() == 4


def test_one_row_a_url(spark):
    have = pages(spark, ("a", "processing"), ("b", "processing"))
    twice = spark.createDataFrame([("a", 500), ("a", 200), ("a", None)], "url string, status_code int")
    done = L.save_results(have, twice).collect()
    assert len(done) == 2 and {r["url"]: r["status_code"] for r in done}["a"] == 500
    assert L.update_status(have, spark.createDataFrame([("a",), ("a",)], "url string"), "skipped").count() == 2
    assert {r["url"] for r in L.add_to_queue(have, spark.createDataFrame([(None,), ("c",)], "url string"), F.lit(5)).collect()} == {"a", "b", "c"}
