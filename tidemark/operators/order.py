"""Arrival order in parts: what a window over all of a key's rows would need, from cells of rows that tasks share.

A cell holds the rows of a run of 2^16 arrival numbers. Cells are counted or folded each by itself, and what
lies before a cell is found from the cells, at most 2^20 of which meet in one window, and the groups
of these. So no task gets all rows of a key, and gaps in the numbers cost nothing but cells.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.plans.stream import Context

#: Bits of arrival numbers that a cell takes, and of cells that one window takes.
CELL, GROUP = 16, 20


class Meet(NamedTuple):
    """How values of cells meet: in a window or group, by name, and that of farther cells with that of nearer ones."""

    agg: Callable[[str], Column]
    group: Callable[[str], Column]
    both: Callable[[Column, Column], Column]


SUM = Meet(F.sum, F.sum, lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
LEAST = Meet(F.min, F.min, F.least)
LAST = Meet(lambda v: F.last(v, ignorenulls=True), lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__at"))), F.coalesce)


def cell() -> Column:
    """The cell of a row, by the first of its order columns."""
    return F.coalesce(F.shiftright("seq", CELL), F.lit(-(1 << 63 - CELL)).cast("long"))


def cells(ctx: Context) -> WindowSpec:
    """Rows of one cell (``__at``) in arrival order."""
    return Window.partitionBy(*ctx.keys, "__at").orderBy(*ctx.order)


def earlier(df: DataFrame, keys: list[str], values: dict[str, Meet], last: bool = False) -> DataFrame:
    """Of rows ``__at`` (unique by keys) with values: keys, ``__at`` and the values over the rows of lower ``__at``, null or 0 for none."""
    up = [] if last else ["__up"]
    df = df.withColumn("__up", F.shiftright("__at", GROUP))
    before = Window.partitionBy(*([*keys, *up] or [F.lit(0)])).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = df.select(*keys, "__at", *up, *(m.agg(v).over(before).alias(v) for v, m in values.items()))
    if last:
        return out
    groups = df.groupBy(*keys, "__up").agg(*(m.group(v).alias(v) for v, m in values.items())).withColumnRenamed("__up", "__at")
    far = earlier(groups, keys, values, True).select(*keys, F.col("__at").alias("__up"), *(F.col(v).alias(f"__far{v}") for v in values))
    out = out.join(far.hint("merge"), [*keys, "__up"])
    return out.select(*keys, "__at", *(m.both(F.col(v), F.col(f"__far{v}")).alias(v) for v, m in values.items()))


def numbered(df: DataFrame, ctx: Context, name: str) -> DataFrame:
    """With each row's place in arrival order, from 0 in each key."""
    keys = list(ctx.keys)
    df = df.withColumn("__at", cell())
    counts = df.groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__before"))
    start = earlier(counts, keys, {"__before": SUM})
    out = df.withColumn(name, F.row_number().over(cells(ctx))).join(start.hint("merge"), [*keys, "__at"])
    return out.withColumn(name, F.col(name) - 1 + F.col("__before")).drop("__at", "__before")
