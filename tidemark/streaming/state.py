"""Runs a state machine over each key's events, in batch and on a stream."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.stream import Context, hidden
from tidemark.schema import EVENT
from tidemark.streaming.machines import Machine

ROWS = 10_000


def output_schema(ctx: Context) -> T.StructType:
    return T.StructType([*EVENT.fields, *(T.StructField(k, T.StringType()) for k in ctx.keys), *(T.StructField(k, T.IntegerType()) for k in ctx.order[1:])])


def scan(df: DataFrame, ctx: Context, machine: Machine, extra: list[str] = ()) -> DataFrame:
    """Feed each key's events to the machine by seq; ``extra`` columns reach it but do not leave."""
    df = df.select(*hidden(ctx), *extra)
    return streaming(df, ctx, machine) if df.isStreaming else batch(df, ctx, machine)


def plain(row: dict) -> dict:
    if isinstance(row["attributes"], list):
        row["attributes"] = dict(row["attributes"])
    return row


def values(column: pa.Array) -> list:
    """Plain Python values, by whole buffers where there are such; maps as dicts."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        ends, start = column.offsets.to_numpy().tolist(), column.offsets[0].as_py()
        if pa.types.is_map(kind):
            flat = list(zip(*(values(c.slice(start, ends[-1] - start)) for c in (column.keys, column.items))))
        else:
            flat = values(column.values.slice(start, ends[-1] - start))
        make = dict if pa.types.is_map(kind) else list
        out = [make(flat[a - start : b - start]) for a, b in zip(ends, ends[1:])]
        return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist())] if column.null_count else out
    if pa.types.is_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def events(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*map(values, batch.columns)))


def batch(df: DataFrame, ctx: Context, machine: Machine) -> DataFrame:
    """One exchange and one sort on the keys; a key's rows stream by, so memory is its state and not its rows."""
    keys, schema = list(ctx.keys), output_schema(ctx)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for b in batches:
            for row in events(b):
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    current, state = key, machine.start()
                out += machine.push(state, row)
                if len(out) >= ROWS:
                    yield records(out, arrow)
                    out = []
        if out:
            yield records(out, arrow)

    dealt = df.repartition(*map(F.col, keys)) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *ctx.order).mapInArrow(run, schema)


def each(df: DataFrame, ctx: Context, push: Callable[[dict], list[dict]]) -> DataFrame:
    """Events one by one, where they lie: no exchange, no sort. The same in batch and on a stream."""
    schema = output_schema(ctx)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in events(b):
                out += push(row)
                if len(out) >= ROWS:
                    yield records(out, arrow)
                    out = []
            if out:
                yield records(out, arrow)

    return df.select(*hidden(ctx)).mapInArrow(run, schema)


def annotate(df: DataFrame, ctx: Context, start: Callable[[], object], step: Callable[..., tuple], inputs: list[str], added: T.StructType) -> DataFrame:
    """Columns that depend on a key's rows before, by ``step(state, *inputs)`` in arrival order.

    One exchange and one sort; only the inputs become Python values, all other columns stay in
    Arrow, and no row is held back.
    """
    import pyarrow.compute as pc

    keys, kinds = list(ctx.keys), [to_arrow_schema(T.StructType([f])).field(0).type for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                c = b.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            first = [b.column(k)[0].as_py() for k in keys]
            new[0] = last is None or first != last
            last = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
            out = []
            for fresh, *values in zip(new.tolist(), *(b.column(c).to_pylist() for c in inputs)):
                if fresh:
                    state = start()
                out.append(step(state, *values))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *added.fieldNames()])

    dealt = df.repartition(*map(F.col, keys)) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *ctx.order).mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def records(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in schema:
        values = [r.get(f.name) for r in rows]
        if pa.types.is_map(f.type):
            values = [None if v is None else list(v.items()) for v in values]
        columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def streaming(df: DataFrame, ctx: Context, machine: Machine) -> DataFrame:
    """The machine's state is kept, pickled, in the state store of the query."""
    schema = output_schema(ctx)
    names = schema.fieldNames()
    keyed = df if ctx.keys else df.withColumn("__all", F.lit("0"))

    def run(key, parts, state):
        own = pickle.loads(state.get[0]) if state.exists else machine.start()
        rows = [clean(r) for part in parts for r in part.to_dict("records")]
        out = [x for r in sorted(rows, key=lambda r: [r[c] for c in ctx.order]) for x in machine.push(own, r)]
        state.update((pickle.dumps(own),))
        frame = {n: pd.Series([r.get(n) for r in out], dtype=object) for n in names}
        for f in schema.fields:
            if isinstance(f.dataType, T.LongType):
                frame[f.name] = frame[f.name].astype("Int64")
            elif isinstance(f.dataType, T.DoubleType):
                frame[f.name] = frame[f.name].astype("float64")
            elif isinstance(f.dataType, T.FloatType):
                frame[f.name] = frame[f.name].astype("float32")
        yield pd.DataFrame(frame)

    return keyed.groupBy(*(ctx.keys or ("__all",))).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def clean(row: dict) -> dict:
    """pandas values back to plain ones."""
    out = {}
    for k, v in row.items():
        if isinstance(v, np.ndarray):
            v = v.tolist()
        elif isinstance(v, (float, np.floating)) and math.isnan(v) or v is pd.NA:
            v = None
        elif isinstance(v, np.generic):
            v = v.item()
        if k in ("seq", "time") and v is not None:
            v = int(v)
        out[k] = v
    return plain(out) if "attributes" in out else out
