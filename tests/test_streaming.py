"""Batch and stream agree on the same files."""

import pytest

from tidemark import operators as O
from tidemark.functions import folds
from tidemark.functions import predicates as P
from tidemark.plans import rules
from tidemark.plans.stream import by
from tidemark.schema import make_events
from tidemark.sources import parquet_stream

PROGRAMS = {
    "stateless": lambda: O.service("a") >> O.above(2) >> O.scale(2) >> O.tag(["x"]),
    "changed_state": lambda: O.changed_state(),
    "counter": lambda: by(["service"], O.counter()),
    "ddt": lambda: by(["service"], O.ddt()),
    "stable": lambda: by(["service"], O.stable(3)),
    "throttle": lambda: by(["service"], O.throttle(2, 4)),
    "moving_events": lambda: by(["service"], O.moving_event_window(3, folds.sum)),
    "fixed_events": lambda: by(["service"], O.fixed_event_window(3, folds.maximum)),
    "moving_time": lambda: by(["service"], O.moving_time_window(4, folds.mean)),
    "hysteresis": lambda: by(["service"], rules.stable_metric(2, P.above(6), P.under(3))),
    "coalesce": lambda: O.coalesce(folds.sum),
    "project": lambda: O.project([P.service("a"), P.service("b")], folds.sum),
    "stable_events": lambda: by(["service"], rules.stable_event_stream(2)),
    "ratio": lambda: rules.ratio("a", "b", 1),
    "percentiles": lambda: by(["service"], O.percentiles(5, [0, 0.5, 1])),
}


def data():
    return [{"seq": i, "time": i // 2, "host": f"h{i % 3}", "service": "ab"[i % 2], "metric": float((i * 7) % 11), "state": "ok" if (i // 5) % 2 else "critical", "ttl": 4.0, "attributes": {"n": str(i)}} for i in range(60)]


def collected(df):
    return sorted((r["seq"], r["time"], r["host"] or "", r["service"] or "", r["state"] or "", r["metric"], tuple(r["tags"] or ()), tuple(sorted((r["attributes"] or {}).items()))) for r in df.collect())


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events"))
    rows = data()
    for lo in range(0, 60, 20):
        make_events(spark, rows[lo : lo + 20]).coalesce(1).write.mode("append").parquet(at)
    return at


def streamed(spark, files, program, name):
    out = program.apply(parquet_stream(spark, files, maxFilesPerTrigger=1))
    query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("name", PROGRAMS)
def test_agrees(spark, files, name):
    got = collected(streamed(spark, files, PROGRAMS[name](), f"out_{name}"))
    want = collected(PROGRAMS[name]().apply(make_events(spark, data())))
    if name == "percentiles":  # the stream knows that an interval is over when its key's next event comes
        want = [r for r in want if r in got]
        assert len(got) >= 3 * 2 * 4
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(abs((a[5] or 0) - (b[5] or 0)) < 1e-9 and a[6:] == b[6:] for a, b in zip(got, want))


def test_fixed_time_window(spark, files):
    program = by(["service"], O.fixed_time_window(5, folds.sum))
    got = collected(streamed(spark, files, program, "out_fixed_time"))
    want = collected(program.apply(make_events(spark, data())))
    assert got and [r[:4] + r[5:6] for r in got] == [r[:4] + r[5:6] for r in want if r in got]
    assert len(want) - len(got) <= 2


def test_rate(spark, files):
    got = streamed(spark, files, O.rate(5), "out_rate").select("time", "metric").collect()
    want = O.rate(5).apply(make_events(spark, data())).select("time", "metric").collect()
    assert got and {tuple(r) for r in got} <= {tuple(r) for r in want}


def test_upsert_index(spark, files, tmp_path):
    from tidemark.plans.index import snapshot, upsert

    query = parquet_stream(spark, files, maxFilesPerTrigger=1).writeStream.foreachBatch(upsert(str(tmp_path))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert collected(spark.read.parquet(str(tmp_path / "v2"))) == collected(snapshot(make_events(spark, data())))


def test_machines_agree_with_plans(spark):
    """The literal machines are a second oracle for the window functions."""
    from tidemark.plans.stream import Context
    from tidemark.streaming import machines
    from tidemark.streaming.state import scan

    events = make_events(spark, data())
    pairs = [(O.counter(), machines.Counter()), (O.ddt(), machines.Ddt()), (O.stable(3), machines.Stable(3)), (O.moving_event_window(3, folds.product), machines.MovingEvents(3, folds.product.python)), (O.moving_time_window(4, folds.minimum), machines.MovingTime(4, folds.minimum.python))]
    for program, machine in pairs:
        assert collected(program.apply(events)) == collected(scan(events, Context(), machine))
