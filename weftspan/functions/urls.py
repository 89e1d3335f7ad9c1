"""URL algebra as Columns: parts, gates, crawl scope; and resolution of references.

Everything but general resolution stays inside the JVM. URLs are never normalised: nodes are
equal when their strings are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The URL schemes that are crawled unless others are named.
DEFAULT_SCHEMES = ("https://", "http://")
SIMPLE_PATH = r"^/[A-Za-z0-9/,._~-]*$"
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
#: What a path may hold unescaped, besides letters and digits; what stays unescaped once anything needs escaping.
PATH_OK, PATH_KEPT = "!$&'()*+,;=:@[]/%-_.~", "$&+,/:;=@-_.~"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    """Host and port, without user info; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 2), r"^.*@", "")


def path(url: Column) -> Column:
    """The decoded path, at least '/'."""
    raw = F.regexp_extract(url, PARTS, 3)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.when(raw == "", "/").when(raw.contains("%"), decoded).otherwise(raw)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def is_external(target: Column, base: Column) -> Column:
    """Whether host or port differ, as strings."""
    return authority(target) != authority(base)


def link_type(target: Column, base: Column) -> Column:
    return F.when(is_external(target, base), "external").otherwise("internal")


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def ignored_href(href: Column) -> Column:
    """References that never are links: empty, fragments, scripts."""
    return (href == "") | href.startswith("#") | href.startswith("javascript:")


def href_gate(href: Column, schemes: Sequence[str] = DEFAULT_SCHEMES) -> Column:
    """Whether a reference, raw or resolved, has an allowed scheme or none.

    One that holds '://' must begin with an allowed scheme, wherever the '://' stands; one that
    holds a colon and doesn't begin like a path, query or fragment must begin with a scheme's name.
    """
    full = any_of([href.startswith(s) for s in schemes])
    short = any_of([href.startswith(s.removesuffix("://")) for s in schemes])
    local = href.startswith("/") | href.startswith("?") | href.startswith("#")
    return F.when(href.contains("://"), full).when(href.contains(":") & ~local, short).otherwise(F.lit(True))


def scheme_gate(url: Column, schemes: Sequence[str] = DEFAULT_SCHEMES) -> Column:
    return any_of([url.startswith(s) for s in (schemes or DEFAULT_SCHEMES)])


def seed_origins(seeds: Sequence[str]) -> list[str]:
    """Distinct origins of seeds, first seen first."""
    out: dict[str, None] = {}
    for seed in seeds:
        try:
            at = urlsplit(seed)
        except ValueError:
            continue
        out[f"{at.scheme}://{at.netloc.rpartition('@')[2]}"] = None
    return list(out)


def host_scope(url: Column, seeds: Sequence[str], follow_external: bool = False, schemes: Sequence[str] = DEFAULT_SCHEMES) -> Column:
    """Whether a URL is a seed's origin or below it; any allowed scheme does if external hosts are followed."""
    if follow_external:
        return scheme_gate(url, schemes)
    return scheme_gate(url, schemes) & any_of([(url == o) | url.startswith(o + "/") for o in seed_origins(seeds)])


def usable(pattern: str) -> bool:
    """Whether both a backtracking and an automaton engine take the pattern: no look-around, no references back."""
    if re.search(r"\(\?<?[=!]|\(\?>|(?<!\\)(\\\\)*\\[1-9]|[*+?}]\+", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def pattern_scope(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any include pattern, if there are some, and no exclude pattern; unusable patterns match nothing."""
    hit = lambda patterns: any_of([url.rlike(p) for p in patterns if usable(p)])
    wanted = hit(include) if include else F.lit(True)
    return wanted & ~hit(exclude)


def crawl_scope(url: Column, seeds: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), follow_external: bool = False, schemes: Sequence[str] = DEFAULT_SCHEMES) -> Column:
    return host_scope(url, seeds, follow_external, schemes) & pattern_scope(url, include, exclude)


def escaped_path(path_: str) -> str:
    """The path as it is if all of it is valid, else escaped as a whole."""
    if all(c in PATH_OK or (c.isascii() and c.isalnum()) for c in path_):
        return path_
    return quote(unquote_to_bytes(path_), safe=PATH_KEPT)


def resolve(base: str, href: str) -> str | None:
    """href as an absolute URL, by the page's own URL (a base element changes nothing); None if it is malformed."""
    if re.search(r"[\x00-\x1f\x7f]", href) or re.search(r"%(?![0-9A-Fa-f]{2})", href.partition("?")[0].partition("#")[0]):
        return None
    if re.match(r"[^/?#]*:", href) and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href):
        return None
    try:
        at = urlsplit(urljoin(base, href))
        at.port  # noqa: B018  raises for a malformed port
    except ValueError:
        return None
    if " " in at.netloc:
        return None
    out = f"{at.scheme}:" if at.scheme else ""
    if at.netloc or at.scheme in ("http", "https"):
        out += f"//{at.netloc}"
    out += escaped_path(at.path)
    if at.query or "?" in href.partition("#")[0]:
        out += f"?{at.query}"
    if at.fragment:
        out += "#" + quote(at.fragment, safe="!$&'()*+,;=:@/?%-_.~")
    return out


@F.pandas_udf(T.StringType())
def resolve_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) if b is not None and h is not None else None for b, h in zip(base, href, strict=True)])


def resolve_rooted(base: Column, href: Column) -> Column:
    """resolve() for references that are a path from the root without escapes, queries and dots: JVM only."""
    kept = F.when(href.rlike(SIMPLE_PATH), href).otherwise(F.replace(F.replace(F.url_encode(href), F.lit("%2F"), F.lit("/")), F.lit("%2C"), F.lit(",")))
    return F.concat(origin(base), kept)
