"""Robots rules: reading robots.txt, and the verdict on a path as a Column over arrays of rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import find_package

#: Groups for any agent, and for agents whose name holds this word, apply.
AGENT_WORD = "crawler"
RULE = "struct<pattern:string,regex:string>"
RULES = "host string, disallow array<struct<pattern:string,regex:string>>, allow array<struct<pattern:string,regex:string>>, crawl_delay double, sitemaps array<string>"


@dataclass
class Rules:
    disallow: list[str] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    crawl_delay: float = 0.0
    sitemaps: list[str] = field(default_factory=list)


def parse(text: str) -> Rules:
    """Rules of all groups that apply, in order. A group is named by the last agent line before its rules."""
    out, applies = Rules(), False
    for line in re.split(r"\r?\n", text):
        name, colon, value = line.strip().partition(":")
        if not colon or name.startswith("#"):
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            applies = value == "*" or AGENT_WORD in value.lower()
        elif name == "sitemap":
            out.sitemaps.append(value)
        elif not applies:
            continue
        elif name == "crawl-delay" and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", value):
            out.crawl_delay = float(value)
        elif name in ("allow", "disallow") and value:
            getattr(out, name).append(value)
    return out


def regex_of(pattern: str) -> str:
    """An anchored regular expression: '*' is any run; a final '$' ends the path only where there is no '*'."""
    if "*" in pattern:
        head, *rest = pattern.split("*")
        return "^" + re.escape(head) + "".join(r"[\s\S]*?" + re.escape(p) for p in rest if p)
    return "^" + (re.escape(pattern[:-1]) + r"\z" if pattern.endswith("$") else re.escape(pattern))


def matches(path: str, pattern: str) -> bool:
    return re.match(regex_of(pattern).replace(r"\z", r"\Z"), path) is not None


def verdict(path: Column, disallow: Column, allow: Column) -> Column:
    """Whether a path is allowed: the first disallow pattern that matches decides, unless a matching allow pattern is longer."""
    hit = F.element_at(F.filter(disallow, lambda r: F.regexp_like(path, r["regex"])), 1)
    better = F.exists(allow, lambda r: F.regexp_like(path, r["regex"]) & (F.octet_length(r["pattern"]) > F.octet_length(hit["pattern"])))
    none = F.size(F.filter(disallow, lambda r: F.regexp_like(path, r["regex"]))) == 0
    return F.when(disallow.isNull() | none, F.lit(True)).otherwise(better)


def read_rules(texts: DataFrame) -> DataFrame:
    """RULES of a frame with host and text, in Arrow batches; a null text has no rules."""
    find_package(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            read = [parse(t or "") for t in rows["text"]]
            ruled = lambda patterns: [{"pattern": p, "regex": regex_of(p)} for p in patterns]
            yield pd.DataFrame({"host": rows["host"], "disallow": [ruled(r.disallow) for r in read], "allow": [ruled(r.allow) for r in read], "crawl_delay": [r.crawl_delay for r in read], "sitemaps": [r.sitemaps for r in read]})

    return texts.select("host", "text").mapInPandas(run, RULES)


def rules_frame(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Rules by host (with port), of robots.txt texts."""
    ruled = lambda patterns: [(p, regex_of(p)) for p in patterns]
    rows = [(h, ruled(r.disallow), ruled(r.allow), r.crawl_delay, r.sitemaps) for h, t in texts.items() for r in [parse(t)]]
    return spark.createDataFrame(rows, T._parse_datatype_string(RULES))


def allowed_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with `allowed`; a host without rules allows everything. The planner broadcasts rules only if they are small."""
    from .urls import authority, path

    joined = urls.withColumn("__host", authority(F.col(url))).join(rules.select(F.col("host").alias("__host"), "disallow", "allow"), "__host", "left")
    return joined.withColumn("allowed", verdict(path(F.col(url)), F.col("disallow"), F.coalesce("allow", F.array().cast(f"array<{RULE}>")))).drop("__host", "disallow", "allow")
