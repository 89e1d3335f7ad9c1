"""python -m weftspan.cli URL…: crawls into a folder of Parquet tables."""

from __future__ import annotations

import argparse
import csv
import os
import sys
from pathlib import Path

from . import __version__, logs, settings
from .session import local_session

CONFIG = "weftspan.yml"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftspan", description="Crawls websites and keeps their link graph as Parquet tables.")
    p.add_argument("urls", nargs="*", help="seed URLs; none goes on with what is queued")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--config", help=f"settings file, ./{CONFIG} if there is one")
    p.add_argument("--query", help="run SQL over the crawl's tables and views, print CSV with a header, and stop")
    p.add_argument("--show-config", action="store_true", help="print the settings without secrets, and stop")
    flags = [
        ("-c", "--concurrency", "concurrency", int), ("-r", "--delay", "request_delay", float), ("-t", "--timeout", "request_timeout", str), ("-u", "--user-agent", "user_agent", str), ("-l", "--limit", "limit", int),
        ("-d", "--database", "warehouse", str), (None, "--auth-type", "auth_type", str), (None, "--auth-username", "auth_username", str), (None, "--auth-password", "auth_password", str),
        (None, "--auth-token", "auth_token", str), (None, "--auth-header", "auth_header", str), (None, "--auth-value", "auth_value", str),
    ]
    for short, name, to, kind in flags:
        p.add_argument(*[x for x in (short, name) if x], dest=to, type=kind)
    for name, to in (("--ignore-robots-txt", "ignore_robots_txt"), ("--follow-external-hosts", "follow_external_hosts")):
        p.add_argument(name, dest=to, action="store_const", const=True)
    for names, to in ((("-H", "--header"), "headers"), (("--include-patterns",), "include_patterns"), (("--exclude-patterns",), "exclude_patterns")):
        p.add_argument(*names, dest=to, action="append")
    return p


def main(args: list[str] | None = None) -> int:
    given = vars(parser().parse_args(args))
    path = given.pop("config") or CONFIG
    show, seeds, sql = given.pop("show_config"), given.pop("urls"), given.pop("query")
    try:
        file = settings.parse_yaml(Path(path).read_text()) if os.path.exists(path) else {}
        s = settings.load(file, os.environ, given | ({"seed_urls": seeds} if seeds else {}))
        if show:
            print(settings.dump_yaml(s.shown()), end="")
            return 0
        s = s.check()
    except settings.SettingsError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if sql:
        return query(sql, s.warehouse)
    log = logs.logger(s.log_level, s.log_file, s.log_max_size, s.log_max_backups, s.log_console)
    from .streaming.loop import Crawl, NothingToDo

    if not s.seed_urls and not os.path.exists(s.warehouse):
        print("error: no seed URLs and no crawl to go on with", file=sys.stderr)
        return 1
    try:
        stats = Crawl(local_session(), s, log=log).run()
    except NothingToDo as e:
        log.info(str(e))
        return 0
    log.info("crawl done", extra={"crawled": stats.crawled, "errors": stats.errors, "skipped": stats.skipped, "seconds": round(stats.seconds, 1)})
    return 0


def query(sql: str, warehouse: str) -> int:
    """Prints a query's rows as CSV; they pass the driver one partition at a time."""
    from .plans.views import register

    spark = local_session(**{"spark.ui.showConsoleProgress": "false"})
    register(spark, warehouse)
    rows = spark.sql(sql)
    out = csv.writer(sys.stdout)
    out.writerow(rows.columns)
    out.writerows(rows.toLocalIterator())
    return 0


if __name__ == "__main__":
    sys.exit(main())
