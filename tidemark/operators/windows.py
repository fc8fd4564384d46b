"""Windows over event counts and event time, rates and percentiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import metric
from tidemark.functions.folds import Fold, fold_groups, fold_structs, fold_window
from tidemark.operators import live, order
from tidemark.plans.stream import Context, Node, Stream, hidden
from tidemark.schema import EVENT, FIELDS
from tidemark.streaming import machines
from tidemark.streaming.state import scan


@dataclass(frozen=True)
class MovingEvents(Node):
    n: int
    fold: Fold

    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, machines.MovingEvents(self.n, self.fold.python)), ctx
        return fold_window(df, ctx.window().rowsBetween(1 - self.n, 0), self.fold).select(hidden(ctx)), ctx


def moving_event_window(n: int, fold: Fold) -> Stream:
    """Per event, the fold of the last n events, fewer at the start."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return Stream((MovingEvents(n, fold),))


@dataclass(frozen=True)
class FixedEvents(Node):
    n: int
    fold: Fold

    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, machines.FixedEvents(self.n, self.fold.python)), ctx
        grouped = order.numbered(df, ctx, "__g").withColumn("__g", F.expr(f"__g div {self.n}"))
        return fold_groups(grouped, [*ctx.keys, "__g"], self.fold, ctx.keys, F.col("__n") == self.n).select(hidden(ctx)), ctx


def fixed_event_window(n: int, fold: Fold) -> Stream:
    """The fold of each complete run of n events."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return Stream((FixedEvents(n, fold),))


@dataclass(frozen=True)
class MovingTime(Node):
    dt: int
    fold: Fold

    def lower(self, df, ctx):
        df = df.filter(F.col("time").isNotNull())
        if df.isStreaming:
            return scan(df, ctx, machines.MovingTime(self.dt, self.fold.python)), ctx
        if ctx.ordered and self.fold.name in live.FOLDS:
            return self.in_order(df, ctx).select(hidden(ctx)), ctx
        df = df.withColumn("__max", F.max("time").over(ctx.running()))
        near = Window.partitionBy(*(ctx.keys or (F.lit(0),))).orderBy("__max").rangeBetween(1 - self.dt, 0)
        slim = F.struct(*((F.map_entries(c).alias(c) if c == "attributes" else F.col(c)) for c in FIELDS))  # maps can't be sorted
        df = df.withColumn("__near", F.collect_list(slim).over(near))
        # rows of the same greatest time are peers, also those that arrive later: these are taken out again
        seen = F.filter("__near", lambda e: (e["seq"] <= F.col("seq")) & (e["time"] > F.col("__max") - self.dt))
        out = df.withColumn("__seen", F.array_sort(seen)).withColumn("__out", fold_structs(F.col("__seen"), self.fold))
        own = {c: F.map_from_entries("__out.attributes") if c == "attributes" else F.col(f"__out.{c}") for c in FIELDS if c != "seq"}
        return out.withColumns(own).select(hidden(ctx)), ctx

    def in_order(self, df: DataFrame, ctx: Context) -> DataFrame:
        """Times in order, by spans of dt seconds: a frame is the end of the span before, folded from its last row back, and its own span up to the event.

        Each row is folded twice, however many a frame holds, and no task needs more of a key than two spans.
        """
        part, start = [*ctx.keys, "__span"], F.col("time") - F.pmod("time", F.lit(self.dt))
        own = df.withColumns({"__span": start, "__t": F.col("time"), "__prior": F.lit(False)})
        if self.dt > 1:
            shifted = {"__span": start + self.dt, "__t": F.col("time") + self.dt, "__prior": F.lit(True)}
            own = own.unionByName(df.withColumns(shifted))
        # a row of the span before counts where its time and dt are later than the event's time
        back = Window.partitionBy(*part).orderBy(F.desc("__t"), "__prior", *(F.desc(c) for c in ctx.order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = Window.partitionBy(*part).orderBy("time", *ctx.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        meet = {"sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + b, "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "product": lambda a, b: F.coalesce(a, F.lit(1.0)) * b, "minimum": F.least, "maximum": F.greatest}
        fields = [c for c in FIELDS if c not in ("seq", "time")]
        parts, value = live.FOLDS[self.fold.name]
        fold = lambda name, m: live.PARTS[name][1](m)
        if self.dt > 1:
            own = own.withColumns({f"__b_{c}": F.last(F.when(F.col("__prior"), F.struct(c)), ignorenulls=True).over(back) for c in fields})
            own = own.withColumns({f"__{n}": fold(n, F.when(F.col("__prior"), live.PARTS[n][0](metric()))).over(back) for n in parts}).filter("not __prior")
        first = {c: F.first(F.struct(c)).over(upto) for c in fields}
        own = own.withColumns({f"__a_{c}": (F.coalesce(f"__b_{c}", v) if self.dt > 1 else v)[c] for c, v in first.items()})
        sums = {n: fold(n, live.PARTS[n][0](metric())).over(upto) for n in parts}
        own = own.withColumns({f"__{n}": meet[n](F.col(f"__{n}"), v) if self.dt > 1 else v for n, v in sums.items()})
        own = own.withColumn("__value", value(F.coalesce("__a_metric", F.lit(0.0))).cast("double"))
        return own.withColumns({c: F.col(f"__a_{c}") for c in fields} | {"metric": F.col("__value")})


def moving_time_window(dt: int, fold: Fold) -> Stream:
    """Per event, the fold of what lies in (m - dt, m], m the greatest time so far."""
    return Stream((MovingTime(dt, fold),))


@dataclass(frozen=True)
class FixedTime(Node):
    dt: int
    fold: Fold

    def lower(self, df, ctx):
        df = df.filter(F.col("time").isNotNull())
        if df.isStreaming:
            marked = df.withColumn("__ts", F.timestamp_seconds("time")).withWatermark("__ts", ctx.delay)
            marked = marked.withColumn("__w", F.window("__ts", f"{self.dt} seconds"))
            return fold_groups(marked, [*ctx.keys, "__w"], self.fold, ctx.keys).select(hidden(ctx)), ctx
        df = df.withColumn("__start", F.col("time") - F.pmod("time", F.lit(self.dt)))
        if not ctx.ordered:  # late: its window was over when it came
            top = F.max("time").over(ctx.running())
            df = df.withColumn("__max", top).filter(F.col("__start") >= F.col("__max") - F.pmod("__max", F.lit(self.dt)))
        done = df.groupBy(*ctx.keys).agg(F.max("time").alias("__top"))
        out = fold_groups(df, [*ctx.keys, "__start"], self.fold, [*ctx.keys, "__start"])
        if ctx.keys:
            out = out.join(done, list(ctx.keys))
        else:
            out = out.crossJoin(F.broadcast(done))  # a single row
        return out.filter(F.col("__start") + self.dt <= F.col("__top")).select(hidden(ctx)), ctx


def fixed_time_window(dt: int, fold: Fold) -> Stream:
    """Tumbling windows aligned at 0; one that is not over yet gives nothing."""
    return Stream((FixedTime(dt, fold),))


@dataclass(frozen=True)
class Rate(Node):
    interval: int
    start: int | None = None

    def lower(self, df, ctx):
        i = self.interval
        if df.isStreaming:
            marked = df.withColumn("__ts", F.timestamp_seconds("time")).withWatermark("__ts", ctx.delay)
            sums = marked.groupBy(*ctx.keys, F.window("__ts", f"{i} seconds").alias("__w")).agg((F.sum(metric()) / i).alias("metric"), F.max("seq").alias("seq"))
            full = sums.withColumn("time", F.unix_seconds("__w.end"))
        else:
            at = F.col("time") - F.pmod("time", F.lit(i))
            sums = df.withColumn("__start", at).groupBy(*ctx.keys, "__start").agg(F.sum(metric()).alias("__sum"), F.max("seq").alias("seq"))
            first = F.lit(self.start).cast("long") if self.start is not None else F.min("__start")
            span = sums.groupBy(*ctx.keys).agg(first.alias("__a"))
            last = sums.agg(F.max("__start").alias("__b"))  # a single row: the clock is one for all keys
            grid = span.crossJoin(F.broadcast(last)).filter(F.col("__b") > F.col("__a")).select(*ctx.keys, F.explode(F.sequence("__a", F.col("__b") - i, F.lit(i).cast("long"))).alias("__start"))
            full = grid.join(sums, [*ctx.keys, "__start"], "left").withColumn("time", F.col("__start") + i).withColumn("metric", F.coalesce("__sum", F.lit(0.0)) / i)
            full = full.withColumn("seq", F.coalesce("seq", F.col("time")))
        empty = {c: F.lit(None).cast(EVENT[c].dataType) for c in FIELDS if c not in ("seq", "time", "metric")}
        empty["tags"], empty["attributes"] = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
        return full.withColumns(empty).select(hidden(ctx)), ctx


def rate(interval: int, start: int | None = None) -> Stream:
    """Sum of metrics by second in each closed interval, 0 for idle ones, timed at its end, without host and service.

    Intervals begin with the first event's, or at ``start``. On a stream, idle intervals give nothing.
    """
    return Stream((Rate(interval, start),))


@dataclass(frozen=True)
class Percentiles(Node):
    interval: int
    ps: tuple[float, ...]

    def lower(self, df, ctx):
        i = self.interval
        if df.isStreaming:
            return scan(df, ctx, machines.Percentiles(i, self.ps)), ctx
        keys = list(ctx.keys)
        base = df.groupBy(*keys).agg(F.min_by(F.struct(*FIELDS), "seq").alias("__base"))
        start = F.col("time") - F.pmod("time", F.lit(i))
        some = df.filter("metric is not null").select(*keys, "metric", start.alias("__start"))
        top = df.agg(F.max("time").alias("__top"))
        some = some.crossJoin(F.broadcast(top)).filter(F.col("__start") + i <= F.col("__top"))  # a single row
        # of each interval only the rows of the ranks asked for go on
        group = Window.partitionBy(*keys, "__start")
        some = some.withColumn("__at", F.row_number().over(group.orderBy("metric")) - 1).withColumn("__n", F.count(F.lit(1)).over(group))
        ps = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(f"{p:.6f}").alias("s")) for p in self.ps))
        n = F.col("__n")
        out = some.withColumn("__p", F.explode(F.filter(ps, lambda p: F.when(p["p"] == 1.0, n - 1).otherwise(F.floor(n * p["p"])) == F.col("__at"))))
        out = out.join(base, keys) if keys else out.crossJoin(F.broadcast(base))  # a single row
        own = {c: F.col(f"__base.{c}") for c in FIELDS}
        own |= {"seq": F.col("__start"), "metric": F.col("metric"), "service": F.concat_ws(" ", F.coalesce("__base.service", F.lit("")), "__p.s")}
        return out.select(*(own[c].cast(EVENT[c].dataType).alias(c) for c in FIELDS), *ctx.keys), ctx


def percentiles(interval: int, ps: list[float]) -> Stream:
    """Exact nearest-rank percentiles of each closed interval; the event is the first ever seen, its service marked with p."""
    return Stream((Percentiles(interval, tuple(ps)),))


__all__ = ["fixed_event_window", "fixed_time_window", "moving_event_window", "moving_time_window", "percentiles", "rate"]
