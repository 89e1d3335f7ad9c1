from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from weftspan.settings import Auth, Settings
from weftspan.sources.fetch import Client, FetchError, Pace, fetch, robots_of
from weftspan.streaming.loop import Crawl, NothingToDo, enqueue_stream


class Site(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    seen: list = []

    def do_GET(self):  # noqa: N802
        Site.seen.append((self.path, dict(self.headers)))
        html = {"/": '<title>Home</title><a href="/articles/ok">ok</a><a href="/pickup/no">no</a><a href="/private/x">p</a><a href="https://other.example/">o</a><a href="/moved">m</a>', "/articles/ok": '<title>Ok</title><a href="/">home</a><a href="/gone">gone</a>', "/target": "<title>T</title><a href='/articles/ok'>x</a>"}
        code, kind, body, more = 200, "text/html", html.get(self.path, "").encode(), {}
        if self.path == "/robots.txt":
            kind, body = "text/plain", b"User-agent: *\nDisallow: /private/\n"
        elif self.path == "/moved":
            code, more = 302, {"Location": "/target"}
        elif self.path == "/loop":
            code, more = 302, {"Location": "/loop"}
        elif self.path == "/data":
            kind, body = "application/json", b"{}"
        elif self.path not in html:
            code, body = 404, b"<title>none</title>"
        self.send_response(code)
        for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), "X-Twice": "1", **more}.items():
            self.send_header(k, v)
        self.send_header("X-Twice", "2")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Site.seen.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_client(site):
    c = Client("agent/1", headers={"X-Own": "v", "accept": "own"}, basic=("u", "p"))
    got = c.get(f"{site}/moved")
    assert (got["status_code"], got["url"], got["final_url"]) == (200, f"{site}/moved", f"{site}/target")
    assert got["headers"]["x-twice"] == "1" and got["response_size_bytes"] == len(got["body"]) and got["download_time_ms"] >= got["ttfb_ms"] >= 0
    sent = Site.seen[0][1]
    assert sent["User-Agent"] == "agent/1" and sent["X-Own"] == "v" and sent["accept"] == "own" and sent["Authorization"] == "Basic dTpw" and "Accept" not in sent
    with pytest.raises(FetchError):
        c.get(f"{site}/loop")
    with pytest.raises(FetchError):
        c.get("ftp://x/")
    with pytest.raises(OSError):
        Client("a", timeout=0.5).get("http://127.0.0.1:1/")
    c.close()


def test_nothing_private_goes_to_another_host(site):
    home = f"http://localhost:{site.rpartition(':')[2]}"
    old, Site.do_GET = Site.do_GET, lambda self: (Site.seen.append((self.path, dict(self.headers))), self.send_response(302 if self.path == "/away" else 200), self.send_header("Location", f"{home}/there"), self.send_header("Content-Length", "0"), self.end_headers())
    try:
        Client("a", bearer="t", api_key=("X-Key", "v"), headers={"X-Own": "o", "Cookie": "c"}).get(f"{site}/away")
    finally:
        Site.do_GET = old
    first, then = (h for _, h in Site.seen)
    assert first["Authorization"] == "Bearer t" and first["X-Key"] == "v" and first["Cookie"] == "c" and first["Accept-Language"]
    assert then["X-Own"] == "o" and not {"Authorization", "X-Key", "Cookie"} & set(then)


def test_ten_requests_at_most(site):
    with pytest.raises(FetchError):
        Client("a").get(f"{site}/loop")
    assert len(Site.seen) == 10


def test_robots_are_asked_for_once(spark, site, tmp_path):
    s = Settings(seed_urls=[f"{site}/"], warehouse=str(tmp_path / "w"), request_timeout=2)
    Crawl(spark, s, batch=1).run()
    Crawl(spark, Settings(seed_urls=[f"{site}/data"], warehouse=s.warehouse, request_timeout=2)).run()
    assert len([1 for p, _ in Site.seen if p == "/robots.txt"]) == 1


def test_a_host_is_one_task_whatever_its_schemes(spark, site):
    frame = spark.createDataFrame([(f"{x}://h{k}.example/",) for k in range(20) for x in ("http", "https")], "url string")
    from pyspark.sql import functions as F

    from weftspan.functions.urls import authority

    dealt = frame.repartition(8, F.lower(authority(F.col("url")))).withColumn("task", F.spark_partition_id())
    assert dealt.groupBy(authority(F.col("url"))).agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


def test_credentials():
    assert Client.of(Settings(auth=Auth(kind="bearer", token="t"))).sent()["Authorization"] == "Bearer t"
    assert Client.of(Settings(auth=Auth(kind="api-key", header="X-Key", value="v"), headers=["X-Key: mine"])).sent()["X-Key"] == "mine"
    assert "secret" not in repr(Client("a", bearer="secret")) and "secret" not in repr(Auth(token="secret"))


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    p = Pace(0.1, lambda: now[0], sleep)
    p.set_delay("slow", 1)
    waits = [round(p.wait(h), 3) for h in ("a", "a", "b", "slow", "slow", "a")]
    assert waits == [0, 0.1, 0, 0, 1, 0] and slept == [0.1, 1]


def test_robots_source(site):
    c = Client("a")
    host = site.removeprefix("http://")
    assert robots_of(c, "http", host).disallow == ["/private/"] and robots_of(c, "http", "127.0.0.1:1") is None


def test_fetch(spark, site):
    urls = [f"{site}/", f"{site}/data", f"{site}/nothing", f"{site}/private/x", "http://127.0.0.1:1/x", "http://h:port/"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r for r in fetch(frame, Settings(request_timeout=2)).collect()}
    assert [got[u]["error_type"] for u in urls] == [None, None, None, "robots_txt_disallow", "network_error", "robots_txt_disallow"]
    assert got[f"{site}/nothing"]["status_code"] == 404
    got = {r["url"]: r for r in fetch(frame, Settings(request_timeout=2, ignore_robots_txt=True)).collect()}
    assert got[f"{site}/private/x"]["status_code"] == 404 and got["http://h:port/"]["error_type"] == "rate_limit_error"


def states(crawl, site):
    return {r["url"].removeprefix(site): r["status"] for r in crawl.pages.collect()}


def test_crawl(spark, site, tmp_path):
    s = Settings(seed_urls=[f"{site}/"], exclude_patterns=["/pickup/"], warehouse=str(tmp_path / "w"), request_timeout=2)
    crawl = Crawl(spark, s)
    stats = crawl.run()
    assert states(crawl, site) == {"/": "completed", "/articles/ok": "completed", "/pickup/no": "discovered", "/private/x": "skipped", "/moved": "completed", "/target": "discovered", "/gone": "completed"}
    assert (stats.crawled, stats.errors, stats.skipped) == (4, 0, 1)
    rows = {r["url"].removeprefix(site): r for r in crawl.pages.collect()}
    assert rows["/"]["title"] == "Home" and rows["/gone"]["status_code"] == 404 and rows["/gone"]["content_hash"] == "" and rows["/moved"]["title"] == "T"
    edges = {(r["source_url"].removeprefix(site), r["target_url"].removeprefix(site)) for r in crawl.links.collect()}
    assert ("/target", "/articles/ok") in edges and ("/", "/pickup/no") in edges and not any("other.example" in t for _, t in edges)
    assert len([1 for p, _ in Site.seen if p == "/articles/ok"]) == 1
    with pytest.raises(NothingToDo):
        Crawl(spark, Settings(warehouse=s.warehouse)).run()


def test_sql_over_a_crawl(spark, site, tmp_path, capsys):
    from weftspan import cli
    from weftspan.plans.views import register

    s = Settings(seed_urls=[f"{site}/"], warehouse=str(tmp_path / "w"), request_timeout=2)
    Crawl(spark, s).run()
    assert set(register(spark, s.warehouse)) == {"pages", "links", "link_relations", "crawl_errors", "crawl_meta", "completed_pages", "queue_status"}
    assert spark.sql("SELECT count(*) FROM link_relations r JOIN pages p ON p.id = r.source_page_id JOIN pages q ON q.id = r.target_page_id").first()[0] == spark.table("links").count()
    assert spark.sql("SELECT title FROM completed_pages ORDER BY ttfb_ms DESC, url LIMIT 10").count() == 5
    assert {r[0] for r in spark.sql("SELECT status FROM queue_status").collect()} == {"completed", "skipped", "discovered"}
    assert cli.main(["--query", "SELECT status, count(*) AS n FROM pages GROUP BY status ORDER BY 1", "-d", s.warehouse]) == 0
    assert capsys.readouterr().out.split() == ["status,n", "completed,5", "discovered,1", "skipped,1"]


def test_include_limit_and_resume(spark, site, tmp_path):
    s = Settings(seed_urls=[f"{site}/"], include_patterns=["/articles/", "/$"], warehouse=str(tmp_path / "w"), limit=1, request_timeout=2)
    crawl = Crawl(spark, s)
    assert crawl.run().crawled == 1
    assert states(crawl, site)["/articles/ok"] == "pending"
    # without seeds the queue is only drained
    again = Crawl(spark, Settings(warehouse=s.warehouse, request_timeout=2))
    assert again.run().crawled == 1
    assert states(again, site)["/gone"] == "discovered"


def test_external_links_are_saved_not_crawled(spark, site, tmp_path):
    s = Settings(seed_urls=[f"{site}/"], follow_external_hosts=True, include_patterns=["/$"], warehouse=str(tmp_path / "w"), request_timeout=2)
    crawl = Crawl(spark, s)
    crawl.run()
    assert states(crawl, site)["https://other.example/"] == "discovered"


def test_dead_host_and_retry(spark, tmp_path):
    s = Settings(seed_urls=["http://127.0.0.1:1/"], warehouse=str(tmp_path / "w"), request_timeout=1, ignore_robots_txt=True)
    crawl = Crawl(spark, s, retries=3)
    assert crawl.run().errors == 1
    assert crawl.pages.first()["status"] == "error" and crawl.errors.count() == 1


def test_stale_claims_are_freed(spark, site, tmp_path):
    from pyspark.sql import functions as F

    from weftspan.operators import lifecycle as L

    s = Settings(seed_urls=[f"{site}/target"], include_patterns=["/target"], warehouse=str(tmp_path / "w"), request_timeout=2)
    crawl = Crawl(spark, s)
    crawl.start()
    crawl.store.write("pages", L.claim_next(crawl.pages, 5, F.current_timestamp())[0])
    assert Crawl(spark, Settings(warehouse=s.warehouse, request_timeout=2)).run().crawled == 1


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftspan.sources.store import Store
    from weftspan.streaming.loop import paced_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"url":"https://a/1"}\n{"url":"https://a/1"}\n{"url":"https://b/2"}\n{"other":1}\n')
    store = Store(spark, str(tmp_path / "w"))
    for _ in range(2):
        enqueue_stream(spark, str(src), store, str(tmp_path / "c"), F.col("url").startswith("https://a")).awaitTermination(120)
    assert [(r["url"], r["status"]) for r in store.read("pages").collect()] == [("https://a/1", "pending")]
    (src / "r.json").write_text("")
    req = tmp_path / "req"
    req.mkdir()
    (req / "1.json").write_text('{"url":"https://a/1","asked_ms":0}\n{"url":"https://a/2","asked_ms":10}\n{"url":"https://b/1","asked_ms":5}\n')
    stream = paced_stream(spark.readStream.schema("url string, asked_ms long").json(str(req)), 100)
    q = stream.writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["url"], r["turn_ms"]) for r in spark.table("turns").collect()} == {("https://a/1", 0), ("https://a/2", 100), ("https://b/1", 5)}
