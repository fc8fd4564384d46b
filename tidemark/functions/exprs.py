"""Column helpers on event fields."""

from __future__ import annotations

from urllib.parse import unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_FIELDS = ("host", "service", "state", "description")
SET_FIELDS = (*STRING_FIELDS, "time", "metric", "ttl")


def metric() -> Column:
    """The metric, 0 where unset."""
    return F.coalesce(F.col("metric"), F.lit(0.0))


def field_str(name: str) -> Column:
    """A field as text: empty where a string field is unset, ``nil`` for a missing attribute or any other name."""
    if name in STRING_FIELDS:
        return F.coalesce(F.col(name), F.lit(""))
    if name in ("time", "metric", "ttl"):
        return F.lit("nil")
    return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.when(F.map_contains_key("attributes", name), F.lit("")), F.lit("nil"))


def has_field(name: str) -> Column:
    """Whether a field is set; names that are no field are attributes."""
    if name in (*STRING_FIELDS, "metric", "ttl"):
        return F.col(name).isNotNull()
    return F.coalesce(F.map_contains_key("attributes", name), F.lit(False))


def full_match(text: Column, regex: str) -> Column:
    return text.rlike(rf"\A(?:{regex})\z")


def like(text: Column, pattern: str) -> Column:
    """``%`` stands for any run of characters; other regex marks keep their meaning."""
    return full_match(text, pattern.replace("%", ".*"))


def metric_str() -> Column:
    return F.when(F.col("metric").isNull(), F.lit("nil")).otherwise(F.format_string("%.6f", "metric"))


def json_str() -> Column:
    """JSON of set fields, attributes at the top level, tags as an array if any; ttl is left out."""
    own = F.to_json(F.struct("host", "service", "description", "state", "time", "metric", F.when(F.size("tags") > 0, F.col("tags")).alias("tags")))
    more = F.to_json("attributes")
    inner = lambda s: F.substring(s, F.lit(2), F.length(s) - 2)
    parts = F.filter(F.array(inner(own), F.coalesce(inner(more), F.lit(""))), lambda x: x != "")
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def report_json() -> Column:
    """JSON of seven fixed fields, with defaults for unset ones, as the offline tester prints events."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "service", "state", "description")]
    return F.to_json(F.struct(*text, F.coalesce("metric", F.lit(0.0)).alias("metric"), F.coalesce("time", F.lit(0)).alias("time"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))


def has_tag(tag: str) -> Column:
    return F.coalesce(F.array_contains("tags", tag), F.lit(False))


def sha1_base64(text: Column) -> Column:
    """The base64 of a SHA-1, as in a websocket handshake."""
    return F.base64(F.unhex(F.sha1(text)))


def parse_uri(uri: str) -> tuple[str, dict[str, str]]:
    """Path and parameters of ``/index?k=v&k=v``, unescaped."""
    path, _, rest = uri.partition("?")
    pairs = [p.partition("=") for p in rest.split("&") if p]
    return unquote_plus(path), {unquote_plus(k): unquote_plus(v) for k, _, v in pairs}


def uri_params(uri: Column) -> Column:
    """The parameters of a URI column as a map."""
    pairs = F.filter(F.split(F.regexp_extract(uri, r"\?(.*)", 1), "&"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)), F.url_decode(F.regexp_extract(p, "=(.*)", 1)))))


def conj(items: Column, item: Column) -> Column:
    return F.array_append(items, item)
