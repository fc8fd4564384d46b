"""Stream programs: chains of nodes, joined by ``>>``, that lower to DataFrame plans.

A node turns a DataFrame of events into another; the same program runs on a batch
table or a streaming one. Nothing is executed while a program is built.

Stateful nodes work in arrival order (``seq``) within the partition keys in force.
``by`` sets these: its key columns travel along as hidden columns, so consecutive stateful
nodes share one exchange and one sort. Without ``by`` there is one global partition:
right, but not for large inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import predicates
from tidemark.functions.exprs import field_str
from tidemark.schema import EVENT, FIELDS


@dataclass(frozen=True)
class Context:
    """Keys in force, clock, and where sinks leave what they would send.

    ``order``: arrival order; behind a node that gives several events for one, hidden columns
    after ``seq`` keep these apart. ``clock``: None for the virtual clock, which is the greatest event time so far,
    or a fixed time. ``ordered``: times never fall along ``seq``, as after the sort that
    the tester does; then the virtual clock is the event's own time.
    """

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ("seq",)
    clock: float | None = None
    ordered: bool = True
    delay: str = "0 seconds"
    reports: list = field(default_factory=list)
    indexed: list = field(default_factory=list)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*(self.keys or (F.lit(0),))).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def now(self) -> Column:
        if self.clock is not None:
            return F.lit(float(self.clock))
        if self.ordered:
            return F.coalesce(F.col("time"), F.lit(0))
        return F.coalesce(F.max("time").over(Window.partitionBy(F.lit(0)).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))


class Node:
    """``lower`` gives the plan and the context for what comes after. ``stateless``: it treats each event by itself."""

    stateless = False

    def lower(self, df: DataFrame, ctx: Context) -> tuple[DataFrame, Context]:
        raise NotImplementedError

    def __rshift__(self, other: Node | Stream) -> Stream:
        return Stream((self,)) >> other


@dataclass(frozen=True)
class Result:
    """What a program forwards, what its sinks would send, and what it indexes (None: no sink of that kind)."""

    events: DataFrame
    reports: DataFrame | None
    indexed: DataFrame | None


@dataclass(frozen=True)
class Stream(Node):
    nodes: tuple[Node, ...] = ()

    @property
    def stateless(self) -> bool:
        return all(n.stateless for n in self.nodes)

    def __rshift__(self, other: Node | Stream) -> Stream:
        return Stream(self.nodes + (other.nodes if isinstance(other, Stream) else (other,)))

    def lower(self, df: DataFrame, ctx: Context) -> tuple[DataFrame, Context]:
        for node in self.nodes:
            df, ctx = node.lower(df, ctx)
        return df, ctx

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        """The events that leave the program."""
        return self.lower(df, ctx or Context())[0].select(FIELDS)

    def run(self, df: DataFrame, ctx: Context | None = None) -> Result:
        ctx = replace(ctx or Context(), reports=[], indexed=[])
        events = self.apply(df, ctx)
        union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
        return Result(events, union(ctx.reports), union(ctx.indexed))


def stream(node: Node | Stream | None) -> Stream:
    return node if isinstance(node, Stream) else Stream((node,) if node else ())


@dataclass(frozen=True)
class Filter(Node):
    stateless = True
    predicate: Callable[[Context], Column] | Column

    def lower(self, df, ctx):
        p = self.predicate(ctx) if callable(self.predicate) and not isinstance(self.predicate, Column) else self.predicate
        return df.filter(p), ctx


@dataclass(frozen=True)
class Assign(Node):
    """Set fields from columns over the event before the change."""

    stateless = True
    changes: dict[str, Column]

    def lower(self, df, ctx):
        return df.withColumns({k: v.cast(EVENT[k].dataType) for k, v in self.changes.items()}), ctx


@dataclass(frozen=True)
class Transform(Node):
    """Any DataFrame function of (df, context) that keeps the event columns and hidden key columns."""

    function: Callable[[DataFrame, Context], DataFrame]

    def lower(self, df, ctx):
        return self.function(df, ctx), ctx


def create_stream(function: Callable[[DataFrame], DataFrame]) -> Stream:
    """A node from a DataFrame function. On a stream it may hold whatever Spark allows there."""
    return Stream((Transform(lambda df, ctx: function(df)),))


@dataclass(frozen=True)
class Machine(Node):
    """A node from ``push(state, event)``: event dicts in arrival order of each key in force, to a list of event dicts."""

    push: Callable[[dict, dict], list[dict]]
    start: Callable[[], dict] = dict

    def lower(self, df, ctx):
        from tidemark.streaming import machines
        from tidemark.streaming.state import scan

        return scan(df, ctx, machines.User(self.push, self.start)), ctx


def create_stateful_stream(push: Callable[[dict, dict], list[dict]], start: Callable[[], dict] = dict) -> Stream:
    """A node with a state (a dict, made by ``start``) for each key in force; the function gives the events that go on. The same in batch and on a stream."""
    return Stream((Machine(push, start),))


@dataclass(frozen=True)
class Forwarding(Node):
    stateless = True
    function: Callable[[dict, Callable[[dict], None]], None]

    def lower(self, df, ctx):
        from tidemark.streaming.state import each

        def push(event: dict) -> list[dict]:
            out: list[dict] = []
            self.function(dict(event), out.append)
            return [event | x for x in out]

        return each(df, ctx, push), ctx


def create_forwarding_stream(function: Callable[[dict, Callable[[dict], None]], None]) -> Stream:
    """A node from ``function(event, forward)``, which forwards what it likes, as often as it likes; it sees each event by itself, in no order."""
    return Stream((Forwarding(function),))


def hidden(ctx: Context) -> list[str]:
    return [*FIELDS, *ctx.keys, *ctx.order[1:]]


def together(ctx: Context, parts: list[tuple[DataFrame, Context]]) -> tuple[DataFrame, Context]:
    """What branches give, as one, in an order that keeps each branch's own."""
    order = max((own.order for _, own in parts), key=len)
    filled = [df.select(*FIELDS, *ctx.keys, *(F.col(c) if c in own.order else F.lit(0).alias(c) for c in order[1:])) for df, own in parts]
    return reduce(DataFrame.unionByName, filled), replace(ctx, order=order)


@dataclass(frozen=True)
class Union(Node):
    """Every event goes to every branch; outputs are concatenated, duplicates kept. No branch at all passes events on."""

    branches: tuple[Stream, ...]

    @property
    def stateless(self) -> bool:
        return all(b.stateless for b in self.branches)

    def lower(self, df, ctx):
        if not self.branches:
            return df, ctx
        return together(ctx, [b.lower(df, ctx) for b in self.branches])


def sdo(*branches: Node | Stream) -> Stream:
    return Stream((Union(tuple(map(stream, branches))),))


svec = sdo


@dataclass(frozen=True)
class Split(Node):
    """The first true clause takes the event; without any, the default, or it passes unchanged."""

    clauses: tuple[tuple[Column, Stream], ...]
    default: Stream

    @property
    def stateless(self) -> bool:
        return self.default.stateless and all(s.stateless for _, s in self.clauses)

    def lower(self, df, ctx):
        ways = [*self.clauses, (F.lit(True), self.default)]
        if all(len(s.nodes) <= 1 and all(isinstance(n, Assign) for n in s.nodes) for _, s in ways):
            return self.collapsed(df, ways), ctx
        parts, taken = [], F.lit(False)
        for p, s in ways:
            parts.append(s.lower(df.filter(p & ~taken), ctx))
            taken = taken | p
        return together(ctx, parts)

    @staticmethod
    def collapsed(df: DataFrame, ways) -> DataFrame:
        """Branches that only set fields: one projection instead of a scan for each."""
        fields = {k for _, s in ways for n in s.nodes for k in n.changes}
        out = {}
        for k in fields:
            value = None
            for p, s in ways:
                own = (s.nodes[0].changes.get(k, F.col(k)) if s.nodes else F.col(k)).cast(EVENT[k].dataType)
                value = F.when(p, own) if value is None else value.when(p, own)
            out[k] = value
        return df.withColumns(out)


def split(clauses: list[tuple[Column, Node | Stream]], default: Node | Stream | None = None) -> Stream:
    return Stream((Split(tuple((p, stream(s)) for p, s in clauses), stream(default)),))


def where(predicate: Column, otherwise: Node | Stream | None = None) -> Stream:
    """Pass events that fit; the others' outputs of ``otherwise`` rejoin."""
    if otherwise is None:
        return Stream((Filter(predicate),))
    return Stream((Split(((predicate, Stream()),), stream(otherwise)),))


@dataclass(frozen=True)
class By(Node):
    keys: tuple[str, ...]
    inner: Stream | None

    @property
    def stateless(self) -> bool:
        return self.inner is None or self.inner.stateless

    def lower(self, df, ctx):
        if not self.keys:
            raise ValueError("by() needs a key: without one it would drop every event")
        names = [f"__k{len(ctx.keys) + i}" for i in range(len(self.keys))]
        inside = replace(ctx, keys=ctx.keys + tuple(names))
        df = df.withColumns({n: field_str(k) for n, k in zip(names, self.keys)})
        if self.inner is None:
            return df, inside
        out, own = self.inner.lower(df, inside)
        after = replace(ctx, order=own.order)
        return out.select(hidden(after)), after


def by(keys: list[str], inner: Node | Stream | None = None) -> Stream:
    """Partition by fields: inside ``inner``, or to the end of the chain."""
    return Stream((By(tuple(keys), None if inner is None else stream(inner)),))


def expired_now(ctx: Context) -> Column:
    return predicates.expired(ctx.now())
