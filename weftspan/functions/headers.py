"""Response headers: from a map to JSON, and from JSON to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header_map(pairs: Column) -> Column:
    """array<struct<name,value>> as a map: lower-case names, the first value of each."""
    names = F.array_distinct(F.transform(pairs, lambda p: F.lower(p["name"])))
    first = lambda n: F.element_at(F.filter(pairs, lambda p: F.lower(p["name"]) == n), 1)["value"]
    return F.map_from_arrays(names, F.transform(names, first))


def headers_json(headers: Column) -> Column:
    return F.to_json(headers)


def header(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def lenient_int(text: Column) -> Column:
    """The number a text begins with, else 0; null for null."""
    prefix = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(prefix.try_cast("bigint"), F.lit(0)))


def with_header_columns(pages: DataFrame, json: str = "response_http_headers") -> DataFrame:
    """pages with the columns that are derived from the headers' JSON."""
    j = F.col(json)
    return pages.withColumns(
        {
            "content_type": header(j, "content-type"),
            "content_length": lenient_int(header(j, "content-length")),
            # HTTP's own date format has no reading here: null, by contract
            "last_modified": F.try_to_timestamp(F.when(header(j, "last-modified").rlike(r"^\d{4}-\d{2}-\d{2}"), header(j, "last-modified"))),
            "server": header(j, "server"),
            "content_encoding": header(j, "content-encoding"),
            "x_cache": header(j, "x-cache"),
        }
    )


def is_html(content_type: Column) -> Column:
    return content_type.startswith("text/html") | content_type.startswith("application/xhtml+xml")


def millis(seconds: Column) -> Column:
    """Whole milliseconds, towards zero."""
    return (seconds * 1000).cast("bigint")
