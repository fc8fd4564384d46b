"""Operators that look at one event: filters, setters, scalar transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.exprs import json_str, metric, report_json
from tidemark.plans.stream import Assign, Filter, Node, Stream, Transform, expired_now

STRING_KEYS = ("host", "service", "description", "state")


def _filter(p: Column | Callable) -> Stream:
    return Stream((Filter(p),))


def _assign(**changes: Column) -> Stream:
    return Stream((Assign(changes),))


def service(s: str) -> Stream:
    return _filter(P.service(s))


def service_any(values: list[str]) -> Stream:
    return _filter(P.match_any("service", values))


def service_like(pattern: str) -> Stream:
    return _filter(P.match_like("service", pattern))


def service_like_any(patterns: list[str]) -> Stream:
    return _filter(P.match_like_any("service", patterns))


def has_attribute(name: str) -> Stream:
    return _filter(P.has_attribute(name))


def state(s: str) -> Stream:
    return _filter(P.state(s))


def state_any(values: list[str]) -> Stream:
    return _filter(P.state_any(values))


def tagged(tag: str) -> Stream:
    return _filter(P.tagged(tag))


def tagged_any(tags: list[str]) -> Stream:
    return _filter(P.tagged_any(tags))


def tagged_all(tags: list[str]) -> Stream:
    return _filter(P.tagged_all(tags))


def above(k: float) -> Stream:
    return _filter(P.above(k))


def under(k: float) -> Stream:
    return _filter(P.under(k))


def within(a: float, b: float) -> Stream:
    return _filter(P.within(a, b))


def without(a: float, b: float) -> Stream:
    return _filter(P.without(a, b))


def expired() -> Stream:
    return _filter(expired_now)


def not_expired() -> Stream:
    return _filter(lambda ctx: ~expired_now(ctx))


def null() -> Stream:
    """Forward nothing."""
    return _filter(F.lit(False))


@dataclass(frozen=True)
class Print(Node):
    stateless = True
    prefix: str

    def lower(self, df, ctx):
        line = F.concat(F.lit(self.prefix), json_str())
        ctx.reports.append(df.select(F.lit("print").alias("method"), "time", line.alias("message"), F.lit("").alias("extra"), report_json().alias("event"), "seq"))
        return df, ctx


def prn(prefix: str = "") -> Stream:
    """Pass all events on; each leaves a report ``print`` of the prefix and the event as JSON, which its transport prints."""
    return Stream((Print(prefix),))


def smap(changes: dict[str, Column] | Callable[[DataFrame], DataFrame]) -> Stream:
    """Change events: by columns, or by any DataFrame function."""
    if callable(changes):
        return Stream((Transform(lambda df, ctx: changes(df)),))
    return _assign(**changes)


def WITH(**changes: Column) -> Stream:
    return _assign(**changes)


def set_service(v: str) -> Stream:
    return _assign(service=F.lit(v))


def set_state(v: str) -> Stream:
    return _assign(state=F.lit(v))


def set_host(v: str) -> Stream:
    return _assign(host=F.lit(v))


def set_metric(v: float) -> Stream:
    return _assign(metric=F.lit(float(v)))


def set_description(v: str) -> Stream:
    return _assign(description=F.lit(v))


def set_ttl(v: float) -> Stream:
    return _assign(ttl=F.lit(v))


def _default(name: str, v) -> Stream:
    return _assign(**{name: F.coalesce(F.col(name), F.lit(v))})


def default_service(v: str) -> Stream:
    return _default("service", v)


def default_state(v: str) -> Stream:
    return _default("state", v)


def default_host(v: str) -> Stream:
    return _default("host", v)


def default_metric(v: float) -> Stream:
    return _default("metric", float(v))


def default_description(v: str) -> Stream:
    return _default("description", v)


def default_ttl(v: float) -> Stream:
    return _default("ttl", float(v))


def _changes(changes: dict[str, str | int | float], only_unset: bool) -> Stream:
    """Typed assignment: strings to string fields or attributes, integers to metric, ttl and time, doubles to metric."""
    out: dict[str, Column] = {}
    attributes = F.col("attributes")
    for key, v in changes.items():
        if isinstance(v, str):
            if key in STRING_KEYS:
                out[key] = F.lit(v)
                continue
            own = F.create_map(F.lit(key), F.lit(v))
            if only_unset:
                attributes = F.when(F.map_contains_key(attributes, key), attributes).otherwise(F.map_concat(attributes, own))
            else:
                attributes = F.map_concat(_without(attributes, key), own)
            out["attributes"] = attributes
        elif isinstance(v, bool) or key not in (("metric", "ttl", "time") if isinstance(v, int) else ("metric",)):
            raise ValueError(f"{key} can't be set to {v!r}")
        else:
            out[key] = F.lit(v)
    if only_unset:
        out = {k: c if k == "attributes" else F.coalesce(F.col(k), c) for k, c in out.items()}
    return _assign(**out)


def _without(attributes: Column, key: str) -> Column:
    return F.map_filter(attributes, lambda k, _: k != key)


def with_(changes: dict[str, str | int | float]) -> Stream:
    return _changes(changes, False)


def default_to(changes: dict[str, str | int | float]) -> Stream:
    return _changes(changes, True)


def scale(s: float) -> Stream:
    """A missing metric counts as 0."""
    return _assign(metric=F.lit(float(s)) * metric())


def tag(tags: list[str]) -> Stream:
    """Append tags; duplicates are kept."""
    return _assign(tags=F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)).cast("array<string>")))


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not n.startswith("_")]
