"""Folds: many events to one.

The result is the first event with a new metric and the greatest time. A fold
lowers to a grouped or windowed aggregate, to an expression over an array of event
structs, and to plain Python for stateful operators.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.exprs import metric
from tidemark.schema import EVENT, FIELDS


@dataclass(frozen=True)
class Fold:
    """``agg(m, seq)`` aggregates rows, ``array(ms)`` an array of metrics in order, ``python(ms)`` a list."""

    name: str
    agg: Callable[[Column, Column], Column] | None
    array: Callable[[Column], Column]
    python: Callable[[list[float]], float]


def _fold_array(start: float, step: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda ms: F.aggregate(ms, F.lit(start), step)


sum = Fold("sum", lambda m, s: F.sum(m), _fold_array(0.0, lambda a, x: a + x), lambda ms: float(builtins.sum(ms)))
product = Fold("product", lambda m, s: F.product(m), _fold_array(1.0, lambda a, x: a * x), lambda ms: float(prod(ms)))
difference = Fold("difference", lambda m, s: 2 * F.min_by(m, s) - F.sum(m), lambda ms: 2 * ms[0] - F.aggregate(ms, F.lit(0.0), lambda a, x: a + x), lambda ms: float(ms[0] - builtins.sum(ms[1:])))
mean = Fold("mean", lambda m, s: F.avg(m), lambda ms: F.aggregate(ms, F.lit(0.0), lambda a, x: a + x) / F.size(ms), lambda ms: builtins.sum(ms) / len(ms))
minimum = Fold("minimum", lambda m, s: F.min(m), F.array_min, lambda ms: float(builtins.min(ms)))
maximum = Fold("maximum", lambda m, s: F.max(m), F.array_max, lambda ms: float(builtins.max(ms)))
count = Fold("count", lambda m, s: F.count(F.lit(1)), lambda ms: F.size(ms).cast("double"), lambda ms: float(len(ms)))
BY_NAME = {f.name: f for f in (sum, product, difference, mean, minimum, maximum, count)}


def user(name: str, python: Callable[[list[float]], float]) -> Fold:
    """A fold from a Python function over metrics in order; it runs as a pandas function over collected arrays."""
    import pandas as pd

    def over(lists):
        return pd.Series([float(python(list(ms))) for ms in lists])

    over.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return Fold(name, None, F.pandas_udf(over, "double"), lambda ms: float(python(ms)))


def collected(fold: Fold, rows: Column) -> Column:
    """A fold that is no aggregate, from rows of (seq, m)."""
    return fold.array(F.transform(F.array_sort(rows), lambda r: r["m"]))


def fold_groups(df: DataFrame, by: list[str], fold: Fold, keep: list[str] = (), having: Column | None = None) -> DataFrame:
    """One event per group: the group's first event with the fold's metric, its greatest time and its last seq."""
    others = [c for c in FIELDS if c not in ("seq", "time", "metric")] + [c for c in keep if c not in by]
    first = [F.min_by(c, "seq").alias(f"__first_{c}") for c in others]  # one by one, so that those not needed are never read
    value = fold.agg(metric(), F.col("seq")) if fold.agg else F.collect_list(F.struct("seq", metric().alias("m")))
    out = df.groupBy(*by).agg(*first, value.alias("__m"), F.max("time").alias("__t"), F.max("seq").alias("__s"), F.count(F.lit(1)).alias("__n"))
    if having is not None:
        out = out.filter(having)
    if not fold.agg:
        out = out.withColumn("__m", collected(fold, F.col("__m")))
    pick = {"seq": F.col("__s"), "time": F.col("__t"), "metric": F.col("__m")}
    return out.select(*((pick.get(c, F.col(f"__first_{c}"))).cast(EVENT[c].dataType).alias(c) for c in FIELDS), *(F.col(c) if c in by else F.col(f"__first_{c}").alias(c) for c in keep))


def fold_window(df: DataFrame, frame: WindowSpec, fold: Fold) -> DataFrame:
    """For each row, the fold over its frame: the frame's first event with a new metric; the row's own seq."""
    first = {c: F.first(F.struct(c)).over(frame)[c] for c in FIELDS if c not in ("seq", "time", "metric")}
    if fold.name == "difference":
        value = 2 * F.first(metric()).over(frame) - F.sum(metric()).over(frame)
    elif fold.agg:
        value = fold.agg(metric(), F.col("seq")).over(frame)
    else:
        df = df.withColumn("__rows", F.collect_list(F.struct("seq", metric().alias("m"))).over(frame))
        value = collected(fold, F.col("__rows"))
    return df.withColumns(first | {"metric": value.cast("double"), "time": F.max("time").over(frame)})


def fold_structs(events: Column, fold: Fold) -> Column:
    """The fold of an array of event structs, as a struct (NULL for an empty array)."""
    ms = F.transform(events, lambda e: F.coalesce(e["metric"], F.lit(0.0)))
    value = fold.array(ms).cast("double")
    time = F.array_max(F.transform(events, lambda e: e["time"]))
    parts = {"time": time, "metric": value}
    return F.when(F.size(events) > 0, F.struct(*((parts[c] if c in parts else events[0][c]).alias(c) for c in FIELDS)))
