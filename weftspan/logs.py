"""Structured logs: one JSON object a line, on the console and in a file that turns over by size."""

from __future__ import annotations

import json
import logging
import logging.handlers
import time

#: Names of levels.
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}
PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def level(name: str) -> int:
    """info for unknown names."""
    return LEVELS.get(name.strip().lower(), logging.INFO)


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "msg": record.getMessage()}
        row |= {k: v for k, v in vars(record).items() if k not in PLAIN}
        return json.dumps(row, default=str, ensure_ascii=False)


def logger(level_name: str = "info", file: str = "", max_mb: float = 100, backups: int = 5, console: bool = True) -> logging.Logger:
    out = logging.getLogger("weftspan")
    for h in list(out.handlers):
        out.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if file:
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=int(max_mb * 1_000_000), backupCount=backups, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(JsonLines())
        out.addHandler(h)
    out.setLevel(level(level_name))
    out.propagate = False
    return out
