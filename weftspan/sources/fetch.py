"""Pages from the network: polite fetching in partitions by host.

All URLs of a host are fetched by one task, one after the other, a delay apart, so politeness
holds without any shared state; a host with very many URLs makes a long task, on purpose.
Fetching has side effects: a caller writes what it returns before using it twice, and runs with
speculation off.
"""

from __future__ import annotations

import base64
import http.client
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robots
from ..functions.urls import authority, scheme
from ..session import find_package
from ..settings import Settings, headers_map

FETCHED = "url string, final_url string, status_code int, headers map<string,string>, body binary, ttfb_ms bigint, download_time_ms bigint, response_size_bytes bigint, error_type string, error_message string"
#: Requests of one page, redirects included; open connections and the seconds they may idle; what a client accepts.
MOST_REQUESTS = 10
MOST_OPEN, MOST_IDLE = 100, 90.0
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
ACCEPT_LANGUAGE = "en-US,en;q=0.5"
#: Headers that go to no other host than the one that a URL names.
PRIVATE = frozenset(("authorization", "cookie", "proxy-authorization"))
REDIRECTS = frozenset((301, 302, 303, 307, 308))


class FetchError(Exception):
    pass


@dataclass
class Client:
    """One task's connections: one for each host, kept open; of many the one idle longest is closed."""

    user_agent: str
    timeout: float = 30.0
    basic: tuple[str, str] | None = field(default=None, repr=False)
    bearer: str = field(default="", repr=False)
    api_key: tuple[str, str] | None = field(default=None, repr=False)
    headers: dict[str, str] = field(default_factory=dict, repr=False)
    _open: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, s: Settings) -> Client:
        """A client with the credentials that settings name, read where the driver runs."""
        a = s.auth
        return cls(
            s.user_agent, s.request_timeout, basic=(a.get("username"), a.get("password")) if a.kind == "basic" else None,
            bearer=a.get("token") if a.kind == "bearer" else "", api_key=(a.get("header"), a.get("value")) if a.kind == "api-key" else None, headers=headers_map(s.headers),
        )

    def sent(self, home: bool = True) -> dict[str, str]:
        """Request headers; custom ones come last and win. Away from home (a redirect to another host) nothing private is sent."""
        out = {"User-Agent": self.user_agent, "Accept": ACCEPT, "Accept-Language": ACCEPT_LANGUAGE}
        if not home:
            return out | {k: v for k, v in self.headers.items() if k.lower() not in PRIVATE}
        if self.basic:
            out["Authorization"] = "Basic " + base64.b64encode(":".join(self.basic).encode()).decode()
        if self.bearer:
            out["Authorization"] = f"Bearer {self.bearer}"
        if self.api_key:
            out[self.api_key[0]] = self.api_key[1]
        names = {k.lower(): k for k in out}
        for k, v in self.headers.items():
            out.pop(names.get(k.lower(), ""), None)
            out[k] = v
        return out

    def _connection(self, key: tuple[str, str]) -> tuple[http.client.HTTPConnection, bool]:
        """A host's connection, and whether it was kept."""
        now = time.monotonic()
        held = self._open.pop(key, None)
        if held and now - held[1] > MOST_IDLE:
            held[0].close()
            held = None
        while len(self._open) >= MOST_OPEN:
            self._open.pop(next(iter(self._open)))[0].close()
        kind = http.client.HTTPSConnection if key[0] == "https" else http.client.HTTPConnection
        out = held[0] if held else kind(key[1].rpartition("@")[2], timeout=self.timeout)
        self._open[key] = (out, now)  # the last one used comes last
        return out, held is not None

    def _ask(self, url: str, home: bool) -> tuple[http.client.HTTPResponse, float]:
        at = urlsplit(url)
        if at.scheme not in ("http", "https") or not at.netloc:
            raise FetchError(f"unsupported URL {url!r}")
        key = (at.scheme, at.netloc)
        target = (at.path or "/") + (f"?{at.query}" if at.query else "")
        for again in (False, True):
            line, kept = self._connection(key)
            try:
                line.request("GET", target.replace(" ", "%20"), headers=self.sent(home))
                return line.getresponse(), time.monotonic()
            except (http.client.RemoteDisconnected, ConnectionResetError, BrokenPipeError, http.client.CannotSendRequest):
                self._open.pop(key)[0].close()
                if again or not kept:  # only a kept connection may have gone stale
                    raise
        raise FetchError("unreachable")

    def get(self, url: str) -> dict:
        """A row of FETCHED without errors; raises for what goes wrong below HTTP."""
        start, here, origin = time.monotonic(), url, urlsplit(url)[:2]
        for _ in range(MOST_REQUESTS):
            answer, first = self._ask(here, urlsplit(here)[:2] == origin)
            body = answer.read()
            place = answer.getheader("Location")
            if answer.status not in REDIRECTS or not place:
                break
            here = urljoin(here, place)
        else:
            raise FetchError(f"{MOST_REQUESTS} requests, and redirected again")
        names: dict[str, str] = {}
        for k, v in answer.getheaders():
            names.setdefault(k.lower(), v)
        end = time.monotonic()
        return {"url": url, "final_url": here, "status_code": answer.status, "headers": names, "body": body, "ttfb_ms": int((first - start) * 1000), "download_time_ms": int((end - start) * 1000), "response_size_bytes": len(body), "error_type": None, "error_message": None}

    def close(self) -> None:
        for c, _ in self._open.values():
            c.close()
        self._open.clear()


class Pace:
    """The least time between two requests to a host; the first goes at once. A host may have a delay of its own."""

    def __init__(self, delay: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep = delay, clock, sleep
        self.own: dict[str, float] = {}
        self.next: dict[str, float] = {}

    def set_delay(self, host: str, delay: float) -> None:
        self.own[host] = delay

    def wait(self, host: str) -> float:
        """Waits for the host's turn; the seconds that took."""
        now = self.clock()
        at = max(now, self.next.get(host, now))
        if at > now:
            self.sleep(at - now)
        self.next[host] = at + self.own.get(host, self.delay)
        return at - now


def failed(url: str, kind: str, message: str) -> dict:
    return {"url": url, "final_url": None, "status_code": None, "headers": None, "body": None, "ttfb_ms": None, "download_time_ms": None, "response_size_bytes": None, "error_type": kind, "error_message": message}


def robots_text(client: Client, scheme_: str, host: str) -> str | None:
    """A host's robots.txt; empty for 404; None where it can't be had (everything is allowed, and nothing is remembered)."""
    try:
        answer = client.get(f"{scheme_}://{host}/robots.txt")
    except (OSError, FetchError, http.client.HTTPException, ValueError):
        return None
    if answer["status_code"] == 404:
        return ""
    return answer["body"].decode("utf-8", "replace") if answer["status_code"] == 200 else None


def robots_of(client: Client, scheme_: str, host: str) -> robots.Rules | None:
    """The rules of robots_text()."""
    text = robots_text(client, scheme_, host)
    return None if text is None else robots.parse(text)


def robots_texts(urls: DataFrame, settings: Settings, client: Client | None = None) -> DataFrame:
    """host and text of the robots.txt of the hosts of urls, one request a host; only those that can be had."""
    find_package(urls.sparkSession)
    worker = client or Client.of(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for rows in batches:
                found = [(h, robots_text(worker, s, h)) for s, h in zip(rows["scheme"], rows["host"], strict=True)]
                yield pd.DataFrame([x for x in found if x[1] is not None], columns=["host", "text"])
        finally:
            worker.close()

    hosts = urls.select(scheme(F.col("url")).alias("scheme"), authority(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.max("scheme").alias("scheme"))
    return hosts.repartition(max(1, settings.concurrency), "host").mapInPandas(run, "host string, text string")


def allowed_by(rules: robots.Rules, path: str) -> bool:
    """robots.verdict() for one path."""
    hit = next((p for p in rules.disallow if robots.matches(path, p)), None)
    return hit is None or any(len(p.encode()) > len(hit.encode()) and robots.matches(path, p) for p in rules.allow)


def fetch(urls: DataFrame, settings: Settings, client: Client | None = None) -> DataFrame:
    """Rows of FETCHED for a frame with `url`; a URL that robots.txt forbids has the error type 'robots_txt_disallow'.

    urls may have `robots`, the text of the host's robots.txt as far as it is known; else it is asked for.
    All URLs of a host are in one task, whatever their schemes.

    error types: 'network_error' for what fails below HTTP, 'rate_limit_error' for a malformed URL
    where robots.txt is ignored and 'robots_txt_disallow' where it isn't.
    """
    from urllib.parse import unquote

    find_package(urls.sparkSession)
    worker = client or Client.of(settings)
    ignore, delay = settings.ignore_robots_txt, settings.request_delay

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, known = Pace(delay), {}
        try:
            for rows in batches:
                out = []
                for url, text in zip(rows["url"], rows["robots"], strict=True):
                    try:
                        at = urlsplit(url)
                        at.port  # noqa: B018  raises for a malformed port
                    except ValueError as e:
                        out.append(failed(url, "rate_limit_error" if ignore else "robots_txt_disallow", str(e)))
                        continue
                    host = at.netloc.rpartition("@")[2]
                    if not ignore:
                        if host not in known and text is not None:
                            known[host] = robots.parse(text)
                        if host not in known and (r := robots_of(worker, at.scheme, host)) is not None:
                            known[host] = r
                        if host in known and not allowed_by(known[host], unquote(at.path) or "/"):
                            out.append(failed(url, "robots_txt_disallow", "disallowed by robots.txt"))
                            continue
                    pace.wait(host)
                    try:
                        out.append(worker.get(url))
                    except (OSError, FetchError, http.client.HTTPException, ValueError) as e:
                        out.append(failed(url, "network_error", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FETCHED.split(", ")])
        finally:
            worker.close()

    tasks = max(1, settings.concurrency)
    own = urls.select("url", F.col("robots") if "robots" in urls.columns else F.lit(None).cast("string").alias("robots"))
    dealt = own.repartition(tasks, F.lower(authority(F.col("url")))).sortWithinPartitions("url")
    return dealt.mapInPandas(run, FETCHED)
