"""Operator vectors: hand-built events in, exact events out."""

import pytest
from pyspark.sql import functions as F

from tidemark import operators as O
from tidemark import sinks
from tidemark.functions import folds
from tidemark.functions import predicates as P
from tidemark.plans.stream import Context, Stream, by, create_stream, sdo, split, where
from tidemark.schema import make_events
from tidemark.tester import VirtualClock, run


def rows(df, *fields):
    got = [tuple(r[f] for f in fields) for r in df.orderBy("seq").collect()]
    return [g[0] for g in got] if len(fields) == 1 else got


def metrics(spark, program, ms, ctx=None, **more):
    events = make_events(spark, [{"metric": m, "time": i, **more} for i, m in enumerate(ms)])
    return rows(program.apply(events, ctx), "metric")


def test_compose(spark):
    add = lambda x: O.WITH(host=F.concat(F.coalesce("host", F.lit("")), F.lit(x)))
    program = add("a") >> add("b") >> (add("c") >> add("d"))
    assert rows(program.apply(make_events(spark, [{}])), "host") == ["abcd"]
    assert rows((create_stream(lambda df: df.filter("metric > 1")) >> add("x")).apply(make_events(spark, [{"metric": 1}, {"metric": 2}])), "host") == ["x"]


def test_setters_and_defaults(spark):
    e = make_events(spark, [{"host": "localhost", "metric": 1}])
    program = O.default_host("h") >> O.default_service("s") >> O.default_metric(2) >> O.default_state("ok") >> O.default_description("d") >> O.default_ttl(5)
    assert rows(program.apply(e), "host", "service", "metric", "state", "description", "ttl") == [("localhost", "s", 1.0, "ok", "d", 5.0)]
    program = O.set_host("a") >> O.set_service("b") >> O.set_state("c") >> O.set_description("d") >> O.set_ttl(3) >> O.set_metric(7)
    assert rows(program.apply(e), "host", "service", "state", "description", "ttl", "metric") == [("a", "b", "c", "d", 3.0, 7.0)]


def test_with_and_default_to(spark):
    e = make_events(spark, [{"host": "x", "attributes": {"foo": "1"}}])
    got = O.with_({"host": "h", "foo": "bar", "metric": 2, "time": 9}).apply(e).first()
    assert (got["host"], got["attributes"], got["metric"], got["time"]) == ("h", {"foo": "bar"}, 2.0, 9)
    got = O.default_to({"host": "h", "foo": "bar", "new": "n", "metric": 2.5}).apply(e).first()
    assert (got["host"], got["attributes"], got["metric"]) == ("x", {"foo": "1", "new": "n"}, 2.5)
    for bad in ({"host": 1}, {"time": 1.5}):
        with pytest.raises(ValueError):
            O.with_(bad)


def test_split_and_where(spark):
    e = make_events(spark, [{"host": "host1", "metric": 1}, {"host": "host2", "metric": 4}, {"host": "host3", "metric": 1}])
    clauses = [(P.match("host", "host1"), O.set_state("one")), (P.above(3.3), O.set_state("big"))]
    assert rows(split(clauses, O.set_state("rest")).apply(e), "state") == ["one", "big", "rest"]
    assert rows(split(clauses).apply(e), "state") == ["one", "big", None]
    stateful = split([(P.match("host", "host1"), O.counter() >> O.set_state("n"))])
    assert rows(stateful.apply(e), "state", "metric") == [("n", 1.0), (None, 4.0), (None, 1.0)]
    assert rows(where(P.match("host", "host1"), O.set_state("else")).apply(e), "state") == [None, "else", "else"]
    assert rows(where(P.match("host", "host1")).apply(e), "host") == ["host1"]
    assert "CASE WHEN" in split(clauses).apply(e)._jdf.queryExecution().optimizedPlan().toString()


def test_sdo(spark):
    e = make_events(spark, [{"metric": 1}])
    assert sorted(rows(sdo(O.set_metric(2), O.set_metric(3)).apply(e), "metric")) == [2.0, 3.0]
    assert rows(sdo().apply(e), "metric") == [1.0]
    assert rows((O.prn() >> O.null()).apply(e), "metric") == []


def test_by(spark):
    keys = [("a", "x"), ("b", "x"), ("a", "y")] * 2
    e = make_events(spark, [{"host": h, "service": s, "metric": 1} for h, s in keys])
    assert rows(by(["host", "service"], O.counter()).apply(e), "metric") == [1, 1, 1, 2, 2, 2]
    assert rows((by(["host"]) >> O.counter()).apply(e), "metric") == [1, 1, 2, 3, 2, 4]
    assert rows((by(["host"]) >> by(["service"], O.counter()) >> O.counter()).apply(e), "metric") == [1, 1, 2, 3, 2, 4]
    with pytest.raises(ValueError):
        by([]).apply(e)


def test_changed_state(spark):
    e = make_events(spark, [{"state": s} for s in "aabbabb"] + [{"state": "b", "service": "new"}])
    assert rows(O.changed_state("a").apply(e), "state", "service") == [("b", None), ("a", None), ("b", None), ("b", "new")]


def test_tags_and_attributes(spark):
    e = make_events(spark, [{"tags": t} for t in ([], ["foo"], ["bar"], ["foo", "bar"])] + [{"attributes": {"k": "v"}}])
    count = lambda p: p.apply(e).count()
    assert [count(O.tagged("foo")), count(O.tagged_any(["foo", "bar"])), count(O.tagged_all(["foo", "bar"])), count(O.tagged_any([])), count(O.tagged_all([]))] == [2, 3, 1, 0, 5]
    assert rows(O.tag(["foo", "bar"]).apply(make_events(spark, [{}])), "tags") == [["foo", "bar"]]
    assert count(O.has_attribute("k")) == 1


def test_stable(spark):
    e = make_events(spark, [{"time": t, "state": s, "metric": m} for t, s, m in [(0, "ok", 0), (1, "ok", 1), (4, "ok", 4), (5, "info", 5), (6, "crit", 6), (7, "crit", 7), (9, "crit", 9), (12, "warn", 12)]])
    assert rows(O.stable(3).apply(e), "metric") == [0, 1, 4, 6, 7, 9]


def test_throttle(spark):
    e = make_events(spark, [{"time": t} for t in (1, 1, 1, 1, 7, 7, 7)])
    assert rows(O.throttle(3, 5).apply(e), "time") == [1, 1, 1, 7, 7, 7]


def test_percentiles(spark):
    e = make_events(spark, [{"time": 1, "metric": i, "service": "s", "host": "h"} for i in range(1000)] + [{"time": 4, "service": "s"}])
    got = O.percentiles(2, [0, 0.5, 1]).apply(e).orderBy("metric").collect()
    assert [(r["metric"], r["service"], r["time"], r["host"]) for r in got] == [(0, "s 0.000000", 1, "h"), (500, "s 0.500000", 1, "h"), (999, "s 1.000000", 1, "h")]


def test_comparisons(spark):
    assert metrics(spark, O.above(5), [2, 7]) == [7]
    assert metrics(spark, O.under(5), [7, 2]) == [2]
    assert metrics(spark, O.within(5, 8), [2, 9, 6, 5]) == [6, 5]
    assert metrics(spark, O.without(5, 8), [6, 2, 9, 5]) == [2, 9]
    assert metrics(spark, O.scale(2), [6, None]) == [12, 0]
    assert metrics(spark, O.under(5), [None]) == [None]


def test_counter(spark):
    assert metrics(spark, O.counter(), [1, 1, None, 1]) == [1, 2, None, 3]


def test_expired(spark):
    e = make_events(spark, [{"time": 0}, {"state": "critical", "time": 0}, {"state": "expired", "time": 0}, {"time": 5}])
    assert [O.expired().apply(e, Context(clock=0)).count(), O.expired().apply(e, Context(clock=100)).count()] == [1, 4]
    assert O.not_expired().apply(e, Context(clock=0)).count() == 3


def test_rate(spark):
    e = make_events(spark, [{"time": t, "metric": m} for t, m in [(5, 10), (6, 20), (9, 30), (10, 40), (11, 20), (15, 1)]])
    got = O.rate(5, start=0).apply(e).orderBy("time").collect()
    assert [(r["time"], r["metric"], r["host"]) for r in got] == [(5, 0.0, None), (10, 12.0, None), (15, 12.0, None)]


SIZES = folds.count


def test_moving_event_window(spark):
    assert metrics(spark, O.moving_event_window(3, SIZES), [0, 1, 2, 3]) == [1, 2, 3, 3]
    assert metrics(spark, O.moving_event_window(3, folds.sum), [0, 1, 2, 3]) == [0, 1, 3, 6]
    assert metrics(spark, O.moving_event_window(3, folds.difference), [5, 1, 2, 3]) == [5, 4, 2, -4]
    with pytest.raises(ValueError):
        O.moving_event_window(0, SIZES)


def test_fixed_event_window(spark):
    e = make_events(spark, [{"metric": i, "host": str(i), "time": i} for i in range(7)])
    assert rows(O.fixed_event_window(3, folds.sum).apply(e), "metric", "host", "time") == [(3, "0", 2), (12, "3", 5)]


@pytest.mark.parametrize("fold", [folds.count, folds.maximum])
def test_moving_time_window(spark, fold):
    e = make_events(spark, [{"time": t, "metric": t, "attributes": {"t": str(t)}} for t in (0, 1, 2, 3, 5, 4, 10)])
    got = O.moving_time_window(3, fold).apply(e, Context(ordered=False))
    assert rows(got, "metric") == ([1, 2, 3, 3, 2, 3, 1] if fold is folds.count else [0, 1, 2, 3, 5, 5, 10])
    assert rows(got, "attributes")[4] == {"t": "3"}


def test_moving_time_window_ordered_agrees(spark):
    e = make_events(spark, [{"time": t, "metric": t} for t in (0, 1, 1, 3, 3, 3, 9)])
    for fold in (folds.sum, folds.count, folds.mean):
        program = O.moving_time_window(3, fold)
        assert rows(program.apply(e, Context(ordered=True)), "metric") == rows(program.apply(e, Context(ordered=False)), "metric")


def test_fixed_time_window(spark):
    e = make_events(spark, [{"time": t, "metric": t} for t in (0, 1, 2, 3, 4, 5, 6, 10, 14, 1)])
    got = O.fixed_time_window(3, folds.sum).apply(e, Context(ordered=False))
    assert rows(got, "metric", "time") == [(3, 2), (12, 5), (6, 6), (10, 10)]


def test_ddt(spark):
    e = make_events(spark, [{"time": 1, "metric": 1}, {"time": 1, "metric": 5}, {"time": 3, "metric": 9}])
    assert rows(O.ddt().apply(e), "metric", "time") == [(2.0, 3)]


LIVE = [("a", 1), ("b", 1), ("c", 1), ("b", 2)]


def test_coalesce(spark):
    e = make_events(spark, [{"host": h, "time": t, "metric": 1} for h, t in LIVE])
    assert rows(O.coalesce(folds.count).apply(e), "metric") == [1, 2, 3, 3]
    late = make_events(spark, [{"host": h, "time": t, "metric": 1} for h, t in [*LIVE, ("b", 90), ("b", 91)]])
    got = rows(O.coalesce(folds.count).apply(late), "seq", "metric")
    assert sorted(got) == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 1), (4, 2), (5, 1)]
    assert sorted(rows(O.coalesce(folds.maximum).apply(late), "seq", "metric")) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (5, 1)]


def test_project(spark):
    preds = [P.match("host", h) for h in "abc"]
    e = make_events(spark, [{"host": h, "time": t, "metric": 1} for h, t in [*LIVE, ("b", 90), ("b", 91), ("z", 92)]])
    for ctx in (Context(), Context(ordered=False)):
        got = rows(O.project(preds, folds.count).apply(e, ctx), "seq", "metric")
        assert sorted(got) == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 1), (4, 2), (5, 1)]


def test_string_filters(spark):
    e = make_events(spark, [{"service": s, "state": s} for s in ("foobar", "bar", "foo", None)])
    count = lambda p: p.apply(e).count()
    assert [count(O.service("foo")), count(O.service_any(["foo", "bar"])), count(O.service_like("foo%")), count(O.service_like_any(["%bar", "x"])), count(O.state("bar")), count(O.state_any(["bar", "foo"])), count(O.service(""))] == [1, 2, 2, 2, 1, 2, 1]


def test_predicates(spark):
    e = make_events(spark, [{"host": "foo", "metric": 5, "attributes": {"k": "v1"}}])
    true = lambda p: e.filter(p).count() == 1
    assert all(map(true, [P.above_eq(5), P.under_eq(5), P.above(4), P.under(6), P.match("k", "v1"), P.match("nokey", "nil"), P.match("time", "nil"), P.match_any("host", ["x", "foo"]), P.match_re("host", "f.o"), P.match_re_any("host", ["x", "fo+"]), P.match_like("k", "v%"), P.match_like_any("k", ["x", "%1"]), P.default_true(), P.state("")]))
    assert not any(map(true, [P.match_re("host", "fo"), P.match_any("host", []), P.above(5), P.tagged("x")]))


def test_folds(spark):
    values = {"sum": ([1] * 5, 5), "product": ([2] * 5, 32), "difference": ([1, 1, 1], -1), "mean": ([1, 2, 3], 2), "maximum": ([1, 3, 2], 3), "minimum": ([2, 1, 3], 1), "count": ([1, None, 3], 3)}
    for name, (ms, want) in values.items():
        fold = folds.BY_NAME[name]
        assert metrics(spark, O.fixed_event_window(len(ms), fold), ms) == [want]
        assert metrics(spark, O.moving_event_window(len(ms), fold), ms)[-1] == want
        assert fold.python([0.0 if m is None else float(m) for m in ms]) == want
    squares = folds.user("squares", lambda ms: sum(m * m for m in ms))
    assert metrics(spark, O.fixed_event_window(3, squares), [1, 2, 3]) == [14]


def test_flagship_rule(spark):
    e = make_events(spark, [{"host": "foo.org", "service": "requests_rate", "time": t, "metric": m} for t, m in [(0, 10), (60, 20), (120, 40), (180, 45), (240, 45), (300, 20), (360, 10)]])
    rule = O.service("requests_rate") >> O.above(40) >> O.set_state("critical") >> O.changed_state() >> sinks.email("localhost", "a@b", "c@d")
    got = run(e, rule)
    assert got["index"] == []
    assert [(m, r["time"], r["event"]["metric"], r["event"]["state"]) for m, r in got["reports"]] == [("email", 180, 45.0, "critical")]


def test_virtual_clock():
    clock, fired = VirtualClock(), []
    clock.periodic(lambda: fired.append(clock.now), 5)
    clock.set_time(5)
    clock.set_time(15)
    assert fired == [5, 10, 15]
    clock.set_time(100)
    clock.set_time(3)
    assert len(fired) == 20 and clock.now == 100
    clock.once(lambda: fired.append("once"), 1, "lib")
    clock.remove("lib")
    clock.set_time(101)
    assert "once" not in fired


def test_empty_program(spark):
    assert Stream().apply(make_events(spark, [{"metric": 1}])).count() == 1
