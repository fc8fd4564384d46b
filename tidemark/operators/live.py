"""Live sets as plans: at every event, a fold over the latest events by host and service that are still alive.

A row of the live set lives from its own event up to the one that replaces it, or up to the first
event whose clock is past its time to live. By place in arrival order that is an interval, and each event asks for
the fold over all intervals that hold its place. Places come in blocks of 4,096. What an interval holds of whole
blocks is cut into dyadic ranges of blocks, which are aggregated once, and a block gathers its own; what is left of it, in
the blocks where it begins and ends, is folded in the block by dyadic ranges of places, in NumPy over the slim columns that
folds need. So each event gives two or three rows, and no task needs more of a key than some blocks at once;
folds are never undone, so sums are exact to rounding, and minima, maxima and products work alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import predicates
from tidemark.operators import order
from tidemark.plans.stream import Context, hidden
from tidemark.schema import EVENT, FIELDS

#: Parts of a fold that can be aggregated in two steps: what a row starts with, and how parts meet.
PARTS: dict[str, tuple[Callable[[Column], Column], Callable[[str], Column]]] = {
    "sum": (lambda m: m, F.sum),
    "product": (lambda m: m, F.product),
    "minimum": (lambda m: m, F.min),
    "maximum": (lambda m: m, F.max),
    "count": (lambda m: F.lit(1).cast("long"), F.sum),
}
#: What each fold is made of, and its value from these and the first event's metric.
FOLDS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "sum": (("sum",), lambda first: F.col("__sum")),
    "product": (("product",), lambda first: F.col("__product")),
    "minimum": (("minimum",), lambda first: F.col("__minimum")),
    "maximum": (("maximum",), lambda first: F.col("__maximum")),
    "count": (("count",), lambda first: F.col("__count").cast("double")),
    "mean": (("sum", "count"), lambda first: F.col("__sum") / F.col("__count")),
    "difference": (("sum",), lambda first: 2 * first - F.col("__sum")),
}


#: Bits of places: of a block, and of all; and the end of what is never gone.
BLOCK, PLACES = 12, 44
SIZE, FOREVER = 1 << BLOCK, 1 << PLACES
#: What a row of a block is: the fold over lives that hold all of it, the end of a life that began before, what expires at a place, an event.
WHOLE, ENDS, TOLD, EVENTS = range(4)
#: Rows that are swept at once, at least.
AT_ONCE = 1 << 17
NO_TIME, MOST = -(1 << 63), (1 << 63) - 1
#: How parts meet in NumPy, and where they start. As in Spark, NaN is the largest.
MEETS = {
    "sum": (np.add, 0.0),
    "product": (np.multiply, 1.0),
    "minimum": (np.fmin, np.nan),
    "maximum": (np.maximum, -np.inf),
    "count": (np.add, 0),
    "time": (np.maximum, NO_TIME),
}


def ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of hosts and services in their order. One task of a key gets these, each once, and not the events."""
    pair = [F.col("__host"), F.col("__service")]
    of = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*pair)
    return df.groupBy(*keys, *pair).agg(F.count(F.lit(1)).alias("__many")).select(*keys, *pair, F.row_number().over(of).cast("long").alias("__rank"))


def overs(df: DataFrame, keys: list[str], low: Column | None) -> DataFrame:
    """Of each deadline (``__due``) ``__over``: the first place whose clock is past it, null for none. By spans of 4,096 seconds: in its own from the last clock back, and what all later spans hold."""
    clock = F.coalesce("time", F.lit(0)) if low is None else F.greatest("time", low)
    both = F.array(F.struct(clock.cast("double").alias("t"), F.lit(0).alias("kind"), F.col("__p").alias("at")), F.struct(F.col("__due").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("at")))
    times = df.select(*keys, F.explode(both).alias("e")).groupBy(*keys, "e.t", "e.kind").agg(F.min("e.at").alias("__over"))
    # spans count down, so that the later ones come before
    times = times.withColumn("__at", F.when(F.isnan("t"), F.lit(-(1 << 50))).otherwise(-F.floor(F.greatest(F.least(F.col("t") / 4096, F.lit(1e15)), F.lit(-1e15)))).cast("long"))
    later = order.earlier(times.groupBy(*keys, "__at").agg(F.min("__over").alias("__over")), keys, {"__over": order.LEAST}).withColumnRenamed("__over", "__later")
    down = Window.partitionBy(*keys, "__at").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = times.withColumn("__over", F.min("__over").over(down)).filter("kind = 1").join(later.hint("merge"), [*keys, "__at"])
    return out.select(*keys, F.col("t").alias("__due"), F.least("__over", "__later").alias("__over"))


def lifetimes(df: DataFrame, ctx: Context) -> DataFrame:
    """Of events with ``__p`` (place in arrival order): ``__rank`` (of host and service), ``__end`` (the place from which on they are gone) and ``__gone`` (by expiry, not replaced)."""
    keys = list(ctx.keys)
    ttl = F.coalesce(F.col("ttl").cast("double"), F.lit(float(predicates.PREDICATE_DEFAULT_TTL)))
    due = F.when(F.col("state").eqNullSafe("expired"), -1.0).otherwise(F.coalesce("time", F.lit(0)) + ttl)
    df = df.withColumns({"__due": due, "__host": F.coalesce("host", F.lit("")), "__service": F.coalesce("service", F.lit(""))}).drop("host", "service", "state", "ttl")
    pair = [*keys, "__host", "__service"]
    out = df.withColumn("__next", F.lead("__p").over(Window.partitionBy(*pair).orderBy("__p"))).join(ranks(df, keys).hint("merge"), pair).drop("__host", "__service")
    if ctx.clock is not None:
        out = out.withColumn("__over", F.when(F.col("__due") < float(ctx.clock), F.col("__p")))
    else:
        out = out.join(overs(df, keys, None if ctx.ordered else F.lit(0)).hint("merge"), [*keys, "__due"])
    out = out.withColumn("__over", F.when(F.col("__over").isNotNull(), F.greatest("__over", "__p")))  # an event can be over when it comes
    gone = F.col("__over").isNotNull() & (F.col("__next").isNull() | (F.col("__over") < F.col("__next")))
    end = F.when(gone, F.col("__over")).otherwise(F.coalesce("__next", F.lit(FOREVER)))
    return out.withColumns({"__gone": gone, "__end": end}).drop("__over", "__next", "__due")


def block(place: str) -> Column:
    return F.shiftright(place, BLOCK)


def ranges() -> Column:
    """The dyadic ranges (level, node) of blocks that make up the blocks wholly in [__p, __end), without that of __p."""
    first, last = block("__p") + 1, block("__end")
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(last - first, F.lit(1)).cast("double"))).cast("int") + 1)

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.call_function("shiftright", first + size - 1, level), F.call_function("shiftright", last, level)
        node = lambda ok, n: F.when((low < high) & ok, F.struct(level.alias("level"), n.cast("long").alias("node")))
        return F.array(node(low % 2 == 1, low), node(high % 2 == 1, high - 1))

    return F.filter(F.when(first < last, F.flatten(F.transform(levels, at))), lambda x: x.isNotNull())


def live_folds(df: DataFrame, ctx: Context, parts: dict[str, Column], greatest_time: bool) -> DataFrame:
    """For each event the parts over the expired it finds (``__sub`` 0) and over what is alive then (1): keys, order, ``__f_`` fields of the first by host and service, parts and time.

    Only what folds need goes through blocks and ranges; the first event's fields are joined at the end.
    The sides of all joins are as large as the input, so none may be broadcast, whatever their size is taken for.
    """
    keys, own_order = list(ctx.keys), [f"__o_{c}" for c in ctx.order]
    placed = order.numbered(df, ctx, "__p").withColumn("__p", F.col("__p").cast("long"))
    own = {f"__{name}": PARTS[name][0](value) if name in PARTS else value for name, value in parts.items()}
    slim = placed.select(*keys, *(F.col(c).alias(o) for c, o in zip(ctx.order, own_order)), "__p", "time", "host", "service", "state", "ttl", *(v.alias(c) for c, v in own.items()))
    lives = lifetimes(slim, ctx).withColumn("__head", F.col("__p"))
    how = [PARTS.get(name, (None, F.sum))[1](f"__{name}").alias(f"__{name}") for name in parts]
    how += [F.min_by("__head", "__rank").alias("__head"), F.min("__rank").alias("__rank"), *([F.max("time").alias("time")] if greatest_time else [])]
    kept = [*own, "__head", "__rank", *(["time"] if greatest_time else [])]
    nodes = lives.select(*keys, *kept, F.explode(ranges()).alias("r")).groupBy(*keys, "r.level", "r.node").agg(*how)
    # each block gathers the ranges that hold it
    asked = placed.select(*keys, block("__p").alias("__block")).distinct().select(*keys, "__block", F.explode(F.sequence(F.lit(0), F.lit(PLACES - BLOCK))).alias("level"))
    asked = asked.withColumn("node", F.call_function("shiftright", F.col("__block"), F.col("level")))
    whole = asked.join(nodes.hint("merge"), [*keys, "level", "node"]).groupBy(*keys, "__block").agg(*how)
    # in its blocks an event is a row of its own, the end of a life that came in from before, and what expires there
    row = lambda kind, place, stop: F.struct(F.lit(kind).alias("__kind"), block(place).alias("__block"), F.col(place).alias("__place"), stop.cast("long").alias("__stop"))
    crosses = (block("__end") > block("__p")) & (F.col("__end") % SIZE > 0) & (F.col("__end") < FOREVER)
    rows = F.array(row(EVENTS, "__p", F.col("__end")), F.when(crosses, row(ENDS, "__end", F.lit(0))), F.when(F.col("__gone"), row(TOLD, "__end", F.lit(0))))
    pieces = lives.select(*keys, *own_order, *kept, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select(*keys, *own_order, *kept, "r.*")
    whole = whole.select(*keys, *kept, "__block", F.lit(WHOLE).alias("__kind"), F.lit(0).cast("long").alias("__place"), F.lit(0).cast("long").alias("__stop"))
    dealt = pieces.unionByName(whole, allowMissingColumns=True).repartition(*map(F.col, keys), "__block").sortWithinPartitions(*keys, "__block", "__kind", "__place")
    out = swept(dealt, keys, own_order, [*parts], greatest_time)
    heads = placed.select(*keys, F.col("__p").alias("__head"), *(F.col(c).alias(f"__f_{c}") for c in FIELDS))
    return out.join(heads.hint("merge"), [*keys, "__head"])


def swept(df: DataFrame, keys: list[str], kept: list[str], parts: list[str], greatest_time: bool) -> DataFrame:
    """Rows of blocks to folds by event, by NumPy over all blocks of a batch at once."""
    values = [f"__{p}" for p in parts] + (["time"] if greatest_time else [])
    meets = {f"__{p}": MEETS.get(p, MEETS["count"]) for p in parts} | {"time": MEETS["time"]}
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(fields[c] for c in (*keys, *kept)), T.StructField("__sub", T.IntegerType()), *(fields[v] for v in values), T.StructField("__head", T.LongType())])
    arrow = to_arrow_schema(schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole blocks, some at once."""
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.flatnonzero(starts(table))
            cut = int(new[-1])
            if cut:
                yield table.slice(0, cut)
            table = thinned(table.slice(cut)) if cut == 0 else table.slice(cut)
            held, n = table.combine_chunks().to_batches(), table.num_rows
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in (*keys, "__block"):
            c = table.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, table.num_rows - 1)).to_numpy()
        return new

    def column(table: pa.Table, name: str) -> np.ndarray:
        if name == "time":
            return pc.fill_null(table.column(name), NO_TIME).to_numpy()
        return table.column(name).to_numpy()

    def thinned(table: pa.Table) -> pa.Table:
        """A large part of a block with ends and expired of one place as one row."""
        kind, place = column(table, "__kind"), column(table, "__place")
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] == EVENTS) | (kind[1:] != kind[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        out = {v: meets[v][0].reduceat(column(table, v), first) for v in values}
        rank = column(table, "__rank")
        least = np.minimum.reduceat(rank, first)
        best = np.flatnonzero(rank == np.repeat(least, np.diff([*first, len(kind)])))
        best = best[np.searchsorted(best, first)]
        table = table.take(best)
        for v, x in out.items():
            a = pa.array(x, table.schema.field(v).type)
            table = table.set_column(table.schema.get_field_index(v), v, pc.if_else(pc.equal(a, NO_TIME), None, a) if v == "time" else a)
        return table

    def fold(n: int, lo: np.ndarray, hi: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Over intervals of places, at each of n places: by dyadic ranges, from single places up and down again."""
        sizes, levels = n, []
        lo, hi = lo.copy(), hi.copy()
        rows = np.arange(len(lo))
        while True:
            at = {c: np.full(sizes, meets[c][1], x.dtype) for c, x in own.items()}
            for node, some in ((lo, (lo < hi) & (lo & 1 == 1)), (hi - 1, (lo < hi) & (hi & 1 == 1) & ~((lo & 1 == 1) & (hi - lo == 1)))):
                for c, x in own.items():
                    meets[c][0].at(at[c], node[some], x[rows[some]])
            levels.append(at)
            lo, hi = lo + 1 >> 1, hi >> 1
            some = lo < hi
            if not some.any():
                break
            lo, hi, rows, sizes = lo[some], hi[some], rows[some], sizes + 1 >> 1
        for low, high in zip(levels[-2::-1], levels[:0:-1]):
            for c in own:
                low[c] = meets[c][0](low[c], np.repeat(high[c], 2)[: len(low[c])])
        return levels[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            kind, place, stop, head, rank = (column(table, c) for c in ("__kind", "__place", "__stop", "__head", "__rank"))
            group = np.cumsum(starts(table)) - 1
            events = np.flatnonzero(kind == EVENTS)
            size = np.bincount(group[events], minlength=group[-1] + 1)
            base = np.cumsum(size) - size  # where a block's places begin among those at hand
            at = base[group] + (place & SIZE - 1)
            end = base[group] + size[group]
            # blocks are full but for the last of a key, and only lives that go on end beyond one
            lo = np.where(kind == EVENTS, at, base[group])
            hi = np.where(kind == EVENTS, np.minimum(at + np.maximum(stop - place, 0), end), np.where(kind == ENDS, np.minimum(at, end), end))
            by_rank = np.argsort(rank, kind="stable")
            turn = np.empty(len(rank), np.int64)
            turn[by_rank] = np.arange(len(rank))
            own = {v: column(table, v) for v in values} | {"__turn": turn}
            n = len(events)
            for sub in (0, 1):
                some = kind == TOLD if sub == 0 else (kind != TOLD) & (lo < hi)
                if not some.any():
                    continue
                got = fold(n, at[some] if sub == 0 else lo[some], at[some] + 1 if sub == 0 else hi[some], {c: x[some] for c, x in own.items()})
                found = np.flatnonzero(got["__turn"] < MOST)
                columns = [table.column(c).take(pa.array(events[found])).combine_chunks() for c in (*keys, *kept)]
                columns.append(pa.array(np.full(len(found), sub, np.int32)))
                for v in values:
                    x = got[v][found]
                    columns.append(pa.array(x, arrow.field(v).type, mask=x == NO_TIME if v == "time" else None))
                columns.append(pa.array(head[by_rank[got["__turn"][found]]]))
                out = pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=arrow)
                yield from out.to_batches(max_chunksize=AT_ONCE)

    meets["__turn"] = (np.minimum, MOST)
    return df.mapInArrow(run, schema)


def told(out: DataFrame, ctx: Context, changes: dict[str, Column]) -> tuple[DataFrame, Context]:
    """Events from the folds: the first event's fields with changes; of one place, what has expired comes first."""
    after = replace(ctx, order=(*ctx.order, f"__sub{len(ctx.order)}"))
    fields = {c: F.col(f"__f_{c}") for c in FIELDS} | {c: F.col(f"__o_{c}") for c in ctx.order} | changes | {after.order[-1]: F.col("__sub")}
    fields = {c: v.cast(EVENT[c].dataType) if c in FIELDS else v for c, v in fields.items()}
    return out.select(*ctx.keys, *(v.alias(c) for c, v in fields.items())).select(hidden(after)), after


def coalesced(df: DataFrame, ctx: Context, fold: str) -> tuple[DataFrame, Context]:
    parts, value = FOLDS[fold]
    m = F.coalesce("metric", F.lit(0.0))
    out = live_folds(df, ctx, {name: m for name in parts}, True)
    return told(out, ctx, {"metric": value(F.coalesce("__f_metric", F.lit(0.0))), "time": F.col("time")})


def counted(df: DataFrame, ctx: Context, p: Column, change: Callable[[Column], dict[str, Column]]) -> tuple[DataFrame, Context]:
    """The first event, changed by the number of those for which ``p`` holds."""
    return told(live_folds(df, ctx, {"hits": F.coalesce(p, F.lit(False)).cast("long")}, False), ctx, change(F.col("__hits")))
