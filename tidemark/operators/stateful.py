"""Operators with state across events: changes, differences, stability, throttling, live sets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import predicates
from tidemark.functions.exprs import metric
from tidemark.functions.folds import Fold
from tidemark.operators import live, order
from tidemark.plans.stream import Context, Node, Stream, hidden
from tidemark.schema import EVENT, FIELDS
from tidemark.streaming import machines
from tidemark.streaming.state import annotate, scan


@dataclass(frozen=True)
class Counter(Node):
    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, machines.Counter()), ctx
        n = F.count("metric").over(ctx.running()).cast("double")
        return df.withColumn("metric", F.when(F.col("metric").isNotNull(), n)), ctx


def counter() -> Stream:
    """The running number of events with a metric replaces their metric."""
    return Stream((Counter(),))


@dataclass(frozen=True)
class Ddt(Node):
    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, machines.Ddt()), ctx
        w, t = ctx.window(), F.coalesce(F.col("time"), F.lit(0))
        df = df.withColumn("__pm", F.lag(metric()).over(w)).withColumn("__pt", F.lag(t).over(w))
        df = df.filter(F.col("__pt").isNotNull() & (F.col("__pt") != t))
        return df.withColumn("metric", (metric() - F.col("__pm")) / (t - F.col("__pt"))).select(hidden(ctx)), ctx


def ddt() -> Stream:
    """Change of the metric by second since the event before; nothing for the first, nor where no time passed."""
    return Stream((Ddt(),))


@dataclass(frozen=True)
class ChangedState(Node):
    initial: str

    def lower(self, df, ctx):
        own = replace(ctx, keys=(*ctx.keys, "__host", "__service"))
        df = df.withColumns({"__host": F.coalesce("host", F.lit("")), "__service": F.coalesce("service", F.lit(""))})
        if df.isStreaming:
            return scan(df, own, machines.ChangedState(self.initial)).select(hidden(ctx)), ctx
        s = F.coalesce("state", F.lit(""))
        return df.withColumn("__before", F.lag(s, 1, self.initial).over(own.window())).filter(F.col("__before") != s).select(hidden(ctx)), ctx


def changed_state(initial: str = "ok") -> Stream:
    """Events whose state differs from the one before, of the same host and service."""
    return Stream((ChangedState(initial),))


@dataclass(frozen=True)
class Stable(Node):
    dt: float

    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, machines.Stable(self.dt)), ctx
        s, t = F.coalesce("state", F.lit("")), F.coalesce(F.col("time"), F.lit(0))
        df = df.withColumn("__chg", (F.lag(s, 1, "").over(ctx.window()) != s).cast("int"))
        df = df.withColumn("__run", F.sum("__chg").over(ctx.running()))
        run = Window.partitionBy(*(ctx.keys or (F.lit(0),)), "__run")
        start = F.first(t).over(run.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        # before any change the run began at time 0
        df = df.withColumn("__t0", F.when(F.col("__run") == 0, F.lit(0)).otherwise(start)).withColumn("__t1", F.max(t).over(run))
        return df.filter((t >= F.col("__t0")) & (F.col("__t1") >= F.col("__t0") + self.dt)).select(hidden(ctx)), ctx


def stable(dt: float) -> Stream:
    """Events of runs of one state that lasted dt, the first ones included."""
    return Stream((Stable(dt),))


@dataclass(frozen=True)
class Throttle(Node):
    n: int
    dt: float

    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, machines.Throttle(self.n, self.dt)), ctx
        n, dt = self.n, self.dt

        def step(period: list, t: int) -> tuple[bool]:
            if period[0] is None or period[0] < t:
                period[:] = [t + dt, 0]
            period[1] += 1
            return (period[1] <= n,)

        marked = annotate(df.select(*hidden(ctx), F.coalesce("time", F.lit(0)).alias("__t")), ctx, lambda: [None, 0], step, ["__t"], T.StructType([T.StructField("__keep", T.BooleanType())]))
        return marked.filter("__keep").select(hidden(ctx)), ctx


def throttle(n: int, dt: float) -> Stream:
    """At most n events in dt seconds, counted from the first event after the last period's end."""
    return Stream((Throttle(n, dt),))


@dataclass(frozen=True)
class Hysteresis(Node):
    dt: float
    trigger: Column
    cancel: Column

    def lower(self, df, ctx):
        marked = df.withColumn("__trigger", F.coalesce(self.trigger, F.lit(False))).withColumn("__cancel", F.coalesce(self.cancel, F.lit(False)))
        if df.isStreaming:
            return scan(marked, ctx, machines.Hysteresis(self.dt), ["__trigger", "__cancel"]), ctx
        dt = self.dt

        def step(s: dict, t: int, trigger: bool, cancel: bool) -> tuple[str, int, bool, bool]:
            state = "critical" if trigger or (s["bad"] and not cancel) else "ok"
            if state != s["state"]:
                s.update(state=state, start=t, open=False, run=s["run"] + 1)
            elif t < s["start"]:
                return state, s["run"], False, s["open"]
            s["open"] = s["open"] or s["start"] + dt <= t
            if s["open"]:
                s["bad"] = state != "ok"
            return state, s["run"], True, s["open"]

        added = T.StructType([T.StructField("__state", T.StringType()), T.StructField("__run", T.LongType()), T.StructField("__in", T.BooleanType()), T.StructField("__open", T.BooleanType())])
        marked = marked.select(*hidden(ctx), "__trigger", "__cancel", F.coalesce("time", F.lit(0)).alias("__t"))
        out = annotate(marked, ctx, lambda: {"state": "", "start": 0, "open": False, "bad": False, "run": 0}, step, ["__t", "__trigger", "__cancel"], added)
        # a run that lasts is let out from its first event on
        lasts = F.max("__open").over(Window.partitionBy(*ctx.keys, "__run"))
        out = out.withColumn("__lasts", lasts).filter("__in and __lasts").withColumn("state", F.col("__state"))
        return out.select(hidden(ctx)), ctx


@dataclass(frozen=True)
class Coalesce(Node):
    fold: Fold

    def lower(self, df, ctx):
        if df.isStreaming or self.fold.name not in live.FOLDS:
            return scan(df, ctx, machines.Coalesce(self.fold.name, self.fold.python, ctx.clock)), ctx
        return live.coalesced(df, ctx, self.fold.name)


def coalesce(fold: Fold) -> Stream:
    """Per event: the fold of what has just expired of the latest events by host and service, then of those alive."""
    return Stream((Coalesce(fold),))


@dataclass(frozen=True)
class CountAlive(Node):
    """The first of the latest events by host and service, its state by whether so many are critical; of those expired first, then of those alive."""

    n: int

    def lower(self, df, ctx):
        name = lambda hits: F.when(hits >= self.n, "critical").otherwise("ok")
        if not df.isStreaming:
            return live.counted(df, ctx, predicates.state("critical"), lambda hits: {"state": name(hits)})
        n = self.n

        def fold(events: list[dict]) -> dict:
            return events[0] | {"state": "critical" if sum(e["state"] == "critical" for e in events) >= n else "ok"}

        return scan(df, ctx, machines.Coalesce("critical", fold, ctx.clock, True)), ctx


@dataclass(frozen=True)
class Project(Node):
    predicates: tuple[Column, ...]
    fold: Fold

    def lower(self, df, ctx):
        marked = df.withColumn("__p", first_of(self.predicates))
        if df.isStreaming or self.fold.agg is None or not (ctx.ordered or ctx.clock is not None):
            return scan(marked, ctx, machines.Project(len(self.predicates), self.fold.python, ctx.clock), ["__p"]), ctx
        return self.native(marked.filter("__p >= 0"), ctx)

    def native(self, df, ctx: Context):
        slots = range(len(self.predicates))
        df = slotted(df, ctx, len(self.predicates))
        outs = []
        for flag in (lambda i: F.col(f"__gone{i}"), alive):
            # each field by itself, so that those not needed are never read
            any_of = lambda c, flag=flag: F.coalesce(*(F.when(flag(i), F.struct(slot(i, c).alias("v"))) for i in slots))["v"]
            picked = F.filter(F.array(*(F.when(flag(i), F.coalesce(slot(i, "metric"), F.lit(0.0))) for i in slots)), lambda m: m.isNotNull())
            times = F.array_max(F.array(*(F.when(flag(i), slot(i, "time")) for i in slots)))
            outs.append((reduce(or_, map(flag, slots)), {c: any_of(c) for c in FIELDS if c != "seq"} | {"time": times, "metric": F.when(F.size(picked) > 0, self.fold.array(picked).cast("double"))}))
        after = replace(ctx, order=(*ctx.order, f"__sub{len(ctx.order)}"))
        subs = F.array(*(F.when(some, F.lit(i)) for i, (some, _) in enumerate(outs)))
        df = df.select("*", F.explode(subs).alias(after.order[-1])).filter(F.col(after.order[-1]).isNotNull())
        gone, live_ = outs[0][1], outs[1][1]
        own = {c: F.when(F.col(after.order[-1]) == 0, gone[c]).otherwise(live_[c]).cast(EVENT[c].dataType) for c in gone}
        return df.withColumns(own).select(hidden(after)), after


def slotted(df, ctx: Context, n: int):
    """Events that fit one of n predicates (``__p``: which), with the fields of each slot's latest event (``slot``), whether that has expired (``__old0`` ...) and is first found so here (``__gone0`` ...).

    Slots are filled by cells of arrival numbers; what a cell starts with comes from the cells before. So no task gets all rows.
    """
    keys, now = list(ctx.keys), ctx.now()
    fields = {f"__s{i}_{c}": F.when(F.col("__p") == i, F.struct(F.col(c).alias("v"))) for i in range(n) for c in FIELDS}
    df = df.withColumns({"__at": order.cell(), "__now": now, **fields})
    df = df.withColumn("__row", F.struct("__now", "__p"))
    held = [*fields, "__row"]
    at = F.struct(*ctx.order)
    ends = df.groupBy(*keys, "__at").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in held))
    starts = order.earlier(ends, keys, dict.fromkeys(held, order.LAST))
    starts = starts.select(*keys, "__at", *(F.col(c).alias(f"{c}_0") for c in held))
    w = order.cells(ctx)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in fields} | {"__row": F.lag("__row").over(w)})
    df = df.join(starts.hint("merge"), [*keys, "__at"]).withColumns({c: F.coalesce(c, f"{c}_0") for c in held}).drop("__at", *(f"{c}_0" for c in held))
    for i in range(n):
        t = F.coalesce(slot(i, "time"), F.lit(0))
        over = lambda now, t=t, i=i: slot(i, "state").eqNullSafe("expired") | ((now >= t) & (now - t > F.coalesce(slot(i, "ttl").cast("double"), F.lit(float(predicates.PREDICATE_DEFAULT_TTL)))))
        df = df.withColumn(f"__old{i}", F.col(f"__s{i}_seq").isNotNull() & (F.col("__p") != i) & over(F.col("__now")))
        # the slot has held the same event since the row before, if that was not its own
        df = df.withColumn(f"__gone{i}", F.col(f"__old{i}") & ~F.coalesce((F.col("__row.__p") != i) & over(F.col("__row.__now")), F.lit(False)))
    return df


def slot(i: int, field: str) -> Column:
    """A field of the latest event of slot i of ``slotted`` events."""
    return F.col(f"__s{i}_{field}.v")


def alive(i: int) -> Column:
    """Of ``slotted`` events, whether slot i holds one that is alive."""
    return F.col(f"__s{i}_seq").isNotNull() & ~F.col(f"__old{i}")


def first_of(preds) -> Column:
    """The number of the first predicate that holds, or -1."""
    first = F.lit(-1)
    for i, p in reversed(list(enumerate(preds))):
        first = F.when(p, F.lit(i)).otherwise(first)
    return first


def project(preds: list[Column], fold: Fold) -> Stream:
    """Align streams: the latest event for each predicate; per matching event the fold of expired ones, then of those alive."""
    return Stream((Project(tuple(preds), fold),))


__all__ = ["changed_state", "coalesce", "counter", "ddt", "project", "stable", "throttle"]
