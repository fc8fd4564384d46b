"""Prebuilt rules, composed of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.folds import Fold
from tidemark.operators.stateful import CountAlive, Hysteresis, alive, coalesce, first_of, slot, slotted, stable
from tidemark.operators.stateless import state_any
from tidemark.plans.stream import Assign, Node, Stream, by, hidden, sdo
from tidemark.schema import FIELDS
from tidemark.streaming import machines
from tidemark.streaming.state import scan


def _state_if(p: Column) -> Stream:
    return Stream((Assign({"state": F.when(p, "critical").otherwise("ok")}),))


def critical_above(v: float) -> Stream:
    return _state_if(P.above(v))


def critical_under(v: float) -> Stream:
    return _state_if(P.under(v))


def stable_metric(dt: float, trigger: Column, cancel: Column | None = None) -> Stream:
    """Critical where ``trigger`` holds, ok otherwise, once that is stable; with ``cancel``, critical until it holds."""
    if cancel is None:
        return _state_if(trigger) >> stable(dt)
    return Stream((Hysteresis(dt, trigger, cancel),))


def agg_stable_metric(dt: float, fold: Fold, trigger: Column, cancel: Column) -> Stream:
    return coalesce(fold) >> stable_metric(dt, trigger, cancel)


def max_critical_hosts(n: int) -> Stream:
    """The first live event, critical if at least n live ones are, ok otherwise."""
    return Stream((CountAlive(n),))


RATIO_SECONDS = 60


@dataclass(frozen=True)
class Ratio(Node):
    a: str
    b: str
    zero: float

    def lower(self, df, ctx):
        zero = self.zero
        marked = df.withColumn("__p", first_of([P.service(self.a), P.service(self.b)]))
        if not df.isStreaming and (ctx.ordered or ctx.clock is not None):
            return self.native(marked.filter("__p >= 0"), ctx), ctx

        def fold(events: list[dict]) -> dict:
            if len(events) < 2 or any(e["metric"] is None for e in events) or abs((events[0]["time"] or 0) - (events[1]["time"] or 0)) >= RATIO_SECONDS:
                return {"service": None, "__none": True}
            x, y = events
            times = [e["time"] for e in events if e["time"] is not None]
            return x | {"metric": zero if y["metric"] == 0 else x["metric"] / y["metric"], "service": f"{x['service']} / {y['service']}", "time": max(times) if times else None}

        out = scan(marked, ctx, machines.Project(2, fold, ctx.clock, True), ["__p"])
        return out.filter(F.col("service").isNotNull()).select(hidden(ctx)), ctx

    def native(self, df, ctx):
        df = slotted(df, ctx, 2)
        x, y = ({c: slot(i, c) for c in FIELDS} for i in range(2))
        near = F.abs(F.coalesce(x["time"], F.lit(0)) - F.coalesce(y["time"], F.lit(0))) < RATIO_SECONDS
        df = df.filter(alive(0) & alive(1) & x["metric"].isNotNull() & y["metric"].isNotNull() & near)
        own = {
            "metric": F.when(y["metric"] == 0, F.lit(float(self.zero))).otherwise(x["metric"] / y["metric"]),
            "service": F.concat_ws(" / ", x["service"], y["service"]),
            "time": F.greatest(x["time"], y["time"]),
        }
        return df.withColumns({c: own.get(c, x[c]) for c in FIELDS if c != "seq"}).select(hidden(ctx))


def ratio(a: str, b: str, zero: float) -> Stream:
    """Metric of service a by that of b, from their latest events if less than 60 s apart; ``zero`` where b is 0."""
    return Stream((Ratio(a, b, zero),))


def per_host_ratio(a: str, b: str, zero: float, dt: float, trigger: Column, cancel: Column) -> Stream:
    return by(["host"], ratio(a, b, zero) >> stable_metric(dt, trigger, cancel))


@dataclass(frozen=True)
class StableEvents(Node):
    n: int

    def lower(self, df, ctx):
        if df.isStreaming:
            return scan(df, ctx, StableEventsMachine(self.n)), ctx
        frame = ctx.window().rowsBetween(1 - self.n, Window.currentRow)
        s = F.coalesce("state", F.lit(""))
        same = (F.min(s).over(frame) == F.max(s).over(frame)) & (F.count(F.lit(1)).over(frame) == self.n)
        return df.withColumn("__same", same & F.col("state").isNotNull()).filter("__same").select(hidden(ctx)), ctx


class StableEventsMachine(machines.Machine):
    def __init__(self, n: int):
        self.n = n

    def push(self, s, e):
        s["last"] = [*s.get("last", []), e["state"]][-self.n :]
        return [e] if len(s["last"]) == self.n and e["state"] is not None and len(set(s["last"])) == 1 else []


def stable_event_stream(n: int) -> Stream:
    """The last event of each n in a row that share their state."""
    return Stream((StableEvents(n),))


@dataclass(frozen=True)
class Targets:
    """Streams that page, mail, index, and all of these."""

    pagerduty: Stream
    email: Stream
    index: Stream
    all: Stream


def create_targets(pd_key: str, to: str, server: str = "localhost", sender: str = "tidemark@localhost") -> Targets:
    from tidemark import sinks
    from tidemark.operators.stateful import changed_state
    from tidemark.plans.stream import split

    changes = state_any(["ok", "critical"]) >> changed_state()
    page = changes >> split([(P.state("ok"), sinks.pagerduty_resolve(pd_key))], sinks.pagerduty_trigger(pd_key))
    mail = changes >> sinks.email(server, sender, to)
    index = sinks.send_index()
    return Targets(page, mail, index, sdo(page, mail, index))
