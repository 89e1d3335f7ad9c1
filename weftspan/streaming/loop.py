"""The crawl: claim a batch, fetch, parse, link, enqueue, save; until nothing is pending.

One driver owns the claims, so no two batches share a page. Everything a batch changes in pages,
links and errors counts from one manifest on; if it dies before, its claims are stale claims of the
next run. Links, errors and robots texts are only added to; pages are written anew. A limit of pages is
met exactly, as a batch never claims more than what is left.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers, urls
from ..functions.html import parse_pages
from ..operators import analytics, graph, lifecycle
from ..settings import Settings
from ..sources import schemas
from ..sources.fetch import Client, fetch, robots_texts
from ..sources.store import Store

LINK_COLUMNS = [c.split()[0] for c in schemas.LINKS.split(", ")]


@dataclass
class Stats:
    started: float = field(default_factory=time.monotonic)
    batches: int = 0
    crawled: int = 0
    errors: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        return time.monotonic() - self.started


class NothingToDo(Exception):
    """There are no seeds, and nothing is pending or being processed."""


class Crawl:
    def __init__(self, spark: SparkSession, settings: Settings, batch: int = 200, retries: int = 0, client: Client | None = None, log=None):
        """retries: how often a page with a retryable error is tried again once the queue is empty."""
        self.spark, self.settings, self.batch, self.retries, self.client, self.log = spark, settings.check(), batch, retries, client, log
        self.store = Store(spark, self.settings.warehouse)
        self.stats = Stats()

    def _table(self, name: str, shape: str) -> DataFrame:
        have = self.store.read(name)
        return have if have is not None else self.spark.createDataFrame([], shape)

    @property
    def pages(self) -> DataFrame:
        return self._table("pages", schemas.PAGES)

    @property
    def links(self) -> DataFrame:
        return self._table("links", schemas.LINKS)

    @property
    def errors(self) -> DataFrame:
        return self._table("errors", schemas.ERRORS)

    def start(self) -> None:
        """Frees all claims of an earlier run, and enqueues seeds."""
        s, now = self.settings, F.current_timestamp()
        have = self.store.read("pages")
        if not s.seed_urls and (have is None or not have.where("status IN ('pending', 'processing')").limit(1).count()):
            raise NothingToDo("no seed URLs, and nothing queued")
        pages = schemas.upgrade_pages(have) if have is not None else self.pages
        pages = lifecycle.reset_stale(pages, F.lit("9999-01-01").cast("timestamp"))
        if seeds := s.seed_urls[: s.limit or None]:
            pages = lifecycle.add_to_queue(pages, self.spark.createDataFrame([(u,) for u in seeds], "url string"), now)
        self.store.write("pages", pages)

    def scope(self):
        s = self.settings
        return urls.crawl_scope(F.col("url"), s.seed_urls, s.include_patterns, s.exclude_patterns, s.follow_external_hosts, s.allowed_schemes)

    def step(self) -> bool:
        """One batch; whether there was anything to do."""
        s, spark = self.settings, self.spark
        left = s.limit - self.stats.crawled if s.limit else self.batch
        now = F.current_timestamp()
        pages, claimed = lifecycle.claim_next(self.pages, min(self.batch, left), now)
        if left <= 0 or not claimed.limit(1).count():
            return False
        pages = self.store.write("pages", pages)
        mine = pages.where("status = 'processing'").select("url")
        # a fetch is done once: its rows are a table before anything reads them
        got = self.store.write("fetched", fetch(mine if s.ignore_robots_txt else self._with_robots(mine), s, self.client))
        ok = got.where("error_type IS NULL").withColumn("is_html", F.coalesce(headers.is_html(F.col("headers")["content-type"]), F.lit(False)) & (F.col("status_code") < 400))
        parsed = parse_pages(ok.where("is_html").select("url", "final_url", F.col("body").alias("html")), s.allowed_schemes, url="final_url").persist()
        empty = F.lit("")
        facts = ["title", "meta_description", "meta_robots", "canonical_url", "content_hash"]
        results = ok.join(parsed.select("url", *facts), "url", "left").select(
            "url", "status_code", *[F.coalesce(c, empty).alias(c) for c in facts], "ttfb_ms", "download_time_ms", "response_size_bytes", headers.headers_json(F.col("headers")).alias("response_http_headers"), now.alias("crawled_at")
        )
        found = graph.links_of_parsed(parsed, "final_url", s.follow_external_hosts).withColumn("crawled_at", now)
        fresh = graph.first_edges(found, ["pos"])
        pair = ["source_url", "target_url"]
        edges = fresh.join(self.links.select(*pair), pair, "left_anti").select(*LINK_COLUMNS)
        # nodes and queue before pages are complete, all in one snapshot
        pages = graph.with_nodes(pages, fresh, now).select(*pages.columns)
        pages = lifecycle.add_to_queue(pages, lifecycle.frontier(fresh, pages, self.scope()), now)
        bad = got.where("error_type IS NOT NULL")
        skipped = bad.where("error_type = 'robots_txt_disallow'").select("url", F.col("error_type").alias("reason"), F.col("error_message").alias("message"))
        failed = bad.where("error_type <> 'robots_txt_disallow'").select("url", "error_type", "error_message")
        pages = lifecycle.save_results(pages, results)
        pages = lifecycle.save_skipped(lifecycle.save_errors(pages, failed), skipped)
        errors = lifecycle.append_errors(self.spark.createDataFrame([], schemas.ERRORS), failed, now)
        self.store.commit({"pages": pages}, {"links": edges, "errors": errors})
        parsed.unpersist()
        n = got.groupBy().agg(F.count_if(F.col("error_type").isNull()).alias("ok"), F.count_if(F.col("error_type") == "robots_txt_disallow").alias("skip"), F.count("*").alias("all")).first()
        self.stats.batches += 1
        self.stats.crawled += n["ok"]
        self.stats.skipped += n["skip"]
        self.stats.errors += n["all"] - n["ok"] - n["skip"]
        self.store.prune()
        if self.log:
            self.log.info("batch done", extra={"batch": self.stats.batches, **self._progress(), **{f"queue_{k}": v for k, v in self.report().items()}})
        return True

    def _with_robots(self, claimed: DataFrame) -> DataFrame:
        """Claimed urls with the robots.txt of their hosts, as far as it can be had; new ones are kept for all later batches and runs."""
        known = self._table("robots", schemas.ROBOTS)
        host = urls.authority(F.col("url"))
        new = claimed.join(known.select("host"), host == F.col("host"), "left_anti")
        if new.limit(1).count():
            self.store.commit(more={"robots": robots_texts(new, self.settings, self.client)})
        texts = self._table("robots", schemas.ROBOTS).groupBy("host").agg(F.max("text").alias("robots"))
        return claimed.join(texts, host == F.col("host"), "left").select("url", "robots")

    def _progress(self) -> dict[str, int]:
        return {"crawled": self.stats.crawled, "errors": self.stats.errors, "skipped": self.stats.skipped, "seconds": int(self.stats.seconds)}

    def report(self) -> dict[str, int]:
        return analytics.status_counts(self.pages).first().asDict()

    def run(self, report_every: float = 10.0) -> Stats:
        """Crawls until nothing is to do; what has been done by then is logged every few seconds, also while a batch runs."""
        over = threading.Event()

        def reporter() -> None:
            while not over.wait(report_every):
                self.log.info("progress", extra=self._progress())

        if self.log:
            threading.Thread(target=reporter, daemon=True).start()
        try:
            return self._run()
        finally:
            over.set()

    def _run(self) -> Stats:
        self.start()
        while True:
            if self.step():
                continue
            if self.retries and not (self.settings.limit and self.stats.crawled >= self.settings.limit) and self.pages.where(lifecycle.is_retryable(self.retries)).limit(1).count():
                self.store.write("pages", lifecycle.requeue_errors(self.pages, self.retries))
                continue
            return self.stats


def enqueue_stream(spark: SparkSession, source: str, store: Store, checkpoint: str, scope=None, available_now: bool = True):
    """Files of URLs (JSON, {"url": …}) as they arrive, put in the queue batch by batch; a batch that is replayed changes nothing."""

    def put(rows: DataFrame, _: int) -> None:
        pages = store.read("pages")
        if pages is None:
            pages = spark.createDataFrame([], schemas.PAGES)
        wanted = rows.where(F.col("url").isNotNull() & (scope if scope is not None else F.lit(True)))
        store.write("pages", lifecycle.add_to_queue(pages, wanted, F.current_timestamp()))

    stream = spark.readStream.schema("url string").json(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="10 seconds")).start()


def paced_stream(requests: DataFrame, delay_ms: int) -> DataFrame:
    """Each request of a stream (url, asked_ms) with the time at which its host's turn comes: state by host, one number."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def turns(key: tuple, frames, state: GroupState):
        free = state.get[0] if state.exists else 0
        for rows in frames:
            rows = rows.sort_values(["asked_ms", "url"])
            out = []
            for asked in rows["asked_ms"]:
                free = max(int(asked), free)
                out.append(free)
                free += delay_ms
            yield pd.DataFrame({"host": key[0], "url": rows["url"].to_numpy(), "turn_ms": out})
        state.update((free,))

    hosts = requests.withColumn("host", urls.authority(F.col("url")))
    return hosts.groupBy("host").applyInPandasWithState(turns, "host string, url string, turn_ms long", "free long", "append", GroupStateTimeout.NoTimeout)
