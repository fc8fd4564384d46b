"""What once took all rows of a key into one task: places, windows, slots and live sets by cells."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from tidemark import operators as O
from tidemark.functions import folds
from tidemark.functions import predicates as P
from tidemark.operators import live, order
from tidemark.operators.stateful import first_of
from tidemark.plans import rules
from tidemark.plans.stream import Context, by
from tidemark.schema import FIELDS, make_events
from tidemark.streaming import machines
from tidemark.streaming.state import scan


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def spread(n, **more):
    """Events of numbers with gaps of all sizes."""
    at = [i * i * 37 + (i // 20) * 10**12 for i in range(n)]
    return [{"seq": s, "time": i, "service": "ab"[i % 3 == 0], "host": f"h{i % 7}", "metric": float(i * 17 % 23), **more} for i, s in enumerate(at)]


@pytest.mark.parametrize("bits", [(16, 20), (1, 2)])
def test_places(spark, monkeypatch, bits):
    monkeypatch.setattr(order, "CELL", bits[0])
    monkeypatch.setattr(order, "GROUP", bits[1])
    rows = spread(100)
    for keys in ((), ("service",)):
        got = order.numbered(make_events(spark, rows), Context(keys=keys), "__n").select("seq", "service", "__n").collect()
        seen, want = {}, {}
        for r in rows:
            k = r["service"] if keys else 0
            seen[k] = seen.get(k, -1) + 1
            want[r["seq"]] = seen[k]
        assert {r["seq"]: r["__n"] for r in got} == want and len(got) == 100


@pytest.mark.parametrize("fold", folds.BY_NAME.values(), ids=folds.BY_NAME)
def test_fixed_events_take_no_key_into_one_task(spark, fold):
    rows = spread(50)
    out = by(["service"], O.fixed_event_window(3, fold)).apply(make_events(spark, rows))
    numbers = [line for line in plan(out).split("\n") if "row_number()" in line and "Window" in line]
    assert numbers and all(re.search(r"windowspecdefinition\(__k0#\d+, __at#", line) for line in numbers)
    want = []
    for s in "ab":
        own = [r for r in rows if r["service"] == s]
        for g in (own[i : i + 3] for i in range(0, len(own) - 2, 3)):
            want.append((g[-1]["seq"], g[-1]["time"], g[0]["host"], s, None, fold.python([r["metric"] for r in g])))
    got = [(r["seq"], r["time"], r["host"], r["service"], r["state"], r["metric"]) for r in out.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["sum", "maximum", "difference"])
def test_moving_time_takes_no_key_into_one_task(spark, name):
    """Spans of time are windows of their own, whose frames only grow: one that slides folds all its rows for each event."""
    fold = folds.BY_NAME[name]
    rows = [{"seq": i, "time": (i * i // 7) % 1000 if i else -3, "service": "ab"[i % 3 == 0], "host": None if i % 4 else f"h{i}", "metric": float(i * 17 % 23)} for i in range(80)]
    for dt in (1, 2, 60):
        out = by(["service"], O.moving_time_window(dt, fold)).apply(make_events(spark, rows))
        windows = [line for line in plan(out).split("\n") if "windowspecdefinition" in line]
        assert windows and all(re.search(r"windowspecdefinition\(__k0#\d+, __span#", line) and "RangeFrame" not in line for line in windows)
        got = {r["seq"]: (r["time"], r["host"], r["metric"]) for r in out.collect()}
        for r in rows:
            near = [x for x in rows if x["service"] == r["service"] and x["seq"] <= r["seq"] and x["time"] > r["time"] - dt]
            assert got.pop(r["seq"]) == (r["time"], near[0]["host"], fold.python([x["metric"] for x in near])), (dt, r)
        assert not got


def random_rows(n):
    rng = random.Random(4)
    out, t, at = [], 0, 0
    for _ in range(n):
        t += rng.choice([0, 1, 5, 40])
        at += rng.choice([1, 2, 3, 9, 300])
        out.append({"seq": at, "time": t, "host": rng.choice(["a", "b", None]), "service": rng.choice("abc"), "metric": rng.choice([None, 0.0, 2.0, float(rng.randint(1, 9))]), "state": rng.choice(["ok", "ok", "critical", "expired"]), "ttl": rng.choice([None, 3.0, 20.0]), "tags": ["x", str(at)], "attributes": {"k": str(at)}})
    return out


@pytest.mark.parametrize(("name", "ctx"), [("mean", Context()), ("difference", Context(clock=400))], ids=["virtual", "fixed"])
def test_slots_are_filled_by_cells(spark, monkeypatch, name, ctx):
    """By cells of four numbers and groups of two of these, the same as a machine that sees one event after the other; all fields."""
    monkeypatch.setattr(order, "CELL", 2)
    monkeypatch.setattr(order, "GROUP", 1)
    events, fold, preds = make_events(spark, random_rows(150)), folds.BY_NAME[name], [P.service("a"), P.service("b"), P.match("host", "b")]
    marked = events.withColumn("__p", first_of(preds))
    out, _ = O.project(preds, fold).lower(events, ctx)
    want = scan(marked, ctx, machines.Project(3, fold.python, ctx.clock), ["__p"])
    show = lambda df: sorted((tuple(str(r[c]) for c in FIELDS) for r in df.select(FIELDS).collect()))
    assert show(out) == show(want) and out.count() > 100
    windows = [line for line in plan(out).split("\n") if "windowspecdefinition" in line]
    assert windows and all(re.search(r"windowspecdefinition\(__(at|up)#|windowspecdefinition\(0, __at#", line) for line in windows)
    ratio = rules.ratio("a", "b", 7).apply(events)
    assert not re.search(r"windowspecdefinition\(0, seq#", plan(ratio))


@pytest.mark.parametrize("name", ["mean", "maximum", "critical"])
def test_live_sets_by_blocks(spark, monkeypatch, name):
    """Blocks of four places, some rows at once: the same as the machine, by lives within a block, across some and without end; places come from cells."""
    for module, values in ((order, {"CELL": 2, "GROUP": 1}), (live, {"BLOCK": 2, "SIZE": 4, "AT_ONCE": 8})):
        for k, v in values.items():
            monkeypatch.setattr(module, k, v)
    rows = random_rows(160)
    for i in range(40):  # all that is alive expires at once
        rows.append({"seq": 10**6 + i, "time": 10**5 + i // 30, "host": f"h{i}", "service": "a", "metric": float(i), "state": "critical", "ttl": 1e6})
    rows.append({"seq": 2 * 10**6, "time": 10**7, "host": "a", "service": "b", "metric": 1.0, "state": "ok", "ttl": 5.0})
    events, ctx = make_events(spark, rows).withColumn("__k0", F.col("service")), Context(keys=("__k0",) if name == "maximum" else ())

    def critical(es):
        return es[0] | {"state": "critical" if sum(e["state"] == "critical" for e in es) >= 2 else "ok"}

    fold = folds.BY_NAME.get(name)
    out, after = (O.coalesce(fold) if fold else rules.max_critical_hosts(2)).lower(events, ctx)
    want = scan(events, ctx, machines.Coalesce(name, fold.python if fold else critical, None, fold is None))
    assert not re.search(r"windowspecdefinition\((0|__k0#\d+), seq#", plan(out))
    show = lambda df: sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else str(r[c]) for c in FIELDS) for r in df.select(FIELDS).collect())
    assert show(out) == show(want)
    assert {r[0] for r in out.select(after.order[-1]).distinct().collect()} == {0, 1}
