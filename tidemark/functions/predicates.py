"""Predicates on events, as boolean columns that are never NULL."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.schema import PREDICATE_DEFAULT_TTL


def above(v: float) -> Column:
    return exprs.metric() > v


def above_eq(v: float) -> Column:
    return exprs.metric() >= v


def under(v: float) -> Column:
    return exprs.metric() < v


def under_eq(v: float) -> Column:
    return exprs.metric() <= v


def within(a: float, b: float) -> Column:
    """Both ends included."""
    return exprs.metric().between(a, b)


def without(a: float, b: float) -> Column:
    return (exprs.metric() < a) | (exprs.metric() > b)


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def match(key: str, value: str) -> Column:
    return exprs.field_str(key) == value


def match_any(key: str, values: list[str]) -> Column:
    return exprs.field_str(key).isin(values) if values else F.lit(False)


def match_re(key: str, regex: str) -> Column:
    return exprs.full_match(exprs.field_str(key), regex)


def match_re_any(key: str, regexes: list[str]) -> Column:
    return any_of([match_re(key, r) for r in regexes])


def match_like(key: str, pattern: str) -> Column:
    return exprs.like(exprs.field_str(key), pattern)


def match_like_any(key: str, patterns: list[str]) -> Column:
    return any_of([match_like(key, p) for p in patterns])


def state(s: str) -> Column:
    return match("state", s)


def state_any(values: list[str]) -> Column:
    return match_any("state", values)


def service(s: str) -> Column:
    return match("service", s)


def default_true() -> Column:
    return F.lit(True)


def has_attribute(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attributes", name), F.lit(False))


def tagged(tag: str) -> Column:
    return exprs.has_tag(tag)


def tagged_any(tags: list[str]) -> Column:
    """False for an empty list."""
    return any_of([exprs.has_tag(t) for t in tags])


def tagged_all(tags: list[str]) -> Column:
    """True for an empty list."""
    return all_of([exprs.has_tag(t) for t in tags])


def expired(now: Column, default_ttl: float = PREDICATE_DEFAULT_TTL) -> Column:
    """State ``expired``, or older than its time to live at ``now``."""
    time = F.coalesce(F.col("time"), F.lit(0))
    return match("state", "expired") | ((now >= time) & ((now - time) > F.coalesce(F.col("ttl").cast("double"), F.lit(float(default_ttl)))))
