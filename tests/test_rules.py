import pytest

from tidemark import operators as O
from tidemark import sinks
from tidemark.functions import folds
from tidemark.functions import predicates as P
from tidemark.plans import index, rules
from tidemark.plans.query import QuerySyntaxError, compile_query
from tidemark.plans.stream import Context
from tidemark.schema import make_events
from tidemark.tester import run
from tests.test_streams import rows


def events(spark, pairs, **more):
    return make_events(spark, [{"time": t, "metric": m, **more} for t, m in pairs])


def test_critical(spark):
    e = events(spark, [(0, 1), (1, 6)])
    assert rows(rules.critical_above(5).apply(e), "state") == ["ok", "critical"]
    assert rows(rules.critical_under(5).apply(e), "state") == ["critical", "ok"]


def test_stable_metric(spark):
    e = events(spark, [(1, 1), (6, 1), (10, 6), (12, 6), (15, 6)])
    ok, bad = [("ok", 1), ("ok", 6)], [("critical", 10), ("critical", 12), ("critical", 15)]
    assert rows(rules.stable_metric(5, P.above(5), P.under(3)).apply(e), "state", "time") == ok + bad
    assert rows(rules.stable_metric(5, P.above(5)).apply(e), "state", "time") == ok + bad
    swap = {"ok": "critical", "critical": "ok"}
    assert rows(rules.stable_metric(5, P.under(5), P.above(3)).apply(e), "state", "time") == [(swap[s], t) for s, t in ok + bad]


def test_agg_stable_metric(spark):
    e = make_events(spark, [{"host": h, "service": "s", "time": t, "metric": m} for h, t, m in [("a", 1, 1), ("b", 1, 1), ("a", 6, 1), ("b", 6, 1), ("a", 7, 1), ("b", 10, 5), ("a", 14, 1), ("b", 16, 5)]])
    got = rows(rules.agg_stable_metric(5, folds.sum, P.above_eq(5), P.under_eq(3)).apply(e), "state", "metric", "time")
    assert got == [("ok", 1, 1), ("ok", 2, 1), ("ok", 2, 6), ("ok", 2, 6), ("ok", 2, 7), ("critical", 6, 10), ("critical", 6, 14), ("critical", 6, 16)]


def test_max_critical_hosts(spark):
    states = [(h, "ok") for h in range(5)] + [(h, "critical") for h in range(3)] + [(h, "ok") for h in range(3)]
    e = make_events(spark, [{"host": str(h), "service": "s", "state": s, "time": 1} for h, s in states])
    program = rules.max_critical_hosts(3) >> O.smap({}) >> O.changed_state("ok")
    assert rows(program.apply(e), "state", "seq") == [("critical", 7), ("ok", 8)]


def test_ratios(spark):
    data = [(0, 1, 5), (100, 1, 5), (200, 1, 1), (400, 1, 1), (500, 1, 1), (600, 1, 5), (900, 1, 5)]
    e = make_events(spark, [{"host": "h", "service": s, "metric": m, "time": t} for t, a, b in data for s, m in (("a", a), ("b", b))])
    got = rows(rules.ratio("a", "b", 1).apply(e), "service", "metric", "time")
    assert got == [("a / b", a / b, t) for t, a, b in data]
    got = rows(rules.per_host_ratio("a", "b", 1, 300, P.above(0.7), P.under(0.5)).apply(e), "state", "time")
    assert [g for g in got if g[1] >= 200] == [("critical", 200), ("critical", 400), ("critical", 500), ("ok", 600), ("ok", 900)]
    zero = make_events(spark, [{"service": "a", "metric": 3, "time": 0}, {"service": "b", "metric": 0, "time": 0}])
    assert rows(rules.ratio("a", "b", 9).apply(zero), "metric") == [9]


def test_stable_event_stream(spark):
    states = ["ok", "critical"] * 3 + ["critical"] * 3 + ["ok", "critical"] * 2 + ["ok"]
    e = make_events(spark, [{"state": s} for s in states])
    assert len(rows(rules.stable_event_stream(3).apply(e), "seq")) == 2 - (states[5] != "critical")
    e = make_events(spark, [{"state": s} for s in ["critical", "ok"] * 3 + ["critical"] * 3 + ["ok", "critical"] * 2])
    assert rows(rules.stable_event_stream(3).apply(e), "seq") == [8]


def test_targets(spark):
    e = make_events(spark, [{"host": "h", "service": "s", "state": s, "time": i} for i, s in enumerate(["ok", "critical", "critical", "ok", "odd"])])
    got = run(e, rules.create_targets("key", "me@here").all)
    assert [(m, r["time"]) for m, r in got["reports"]] == [("email", 1), ("pagerduty_trigger", 1), ("email", 3), ("pagerduty_resolve", 3)]
    assert [x["time"] for x in got["index"]] == [0, 1, 2, 3, 4]
    assert run(e, sinks.send_graphite("g", 2003))["reports"][0][1]["message"] == "h.s 0.0 0"


CASES = [
    ("true", {}, True), ("(true)", {}, True), ('tagged "foo"', {"tags": ["foo"]}, True), ('tagged = "bar"', {"tags": ["foo"]}, False),
    ('tagged "a" and tagged "b"', {"tags": ["a"]}, False), ('tagged "a" or tagged "b"', {"tags": ["b"]}, True), ('not tagged "a"', {"tags": ["b"]}, True),
    ('host = "h"', {"host": "h"}, True), ('host = ""', {}, True), ('service = "s"', {"service": "t"}, False), ('state = "x"', {"state": "x"}, True),
    ('description =~ "foob%"', {"description": "foobar"}, True), ('description =~ "foob"', {"description": "foobar"}, False), ('host > "a"', {"host": "b"}, False),
    ("time = 7", {"time": 7}, True), ("time = 0", {}, True), ("ttl > 5", {"ttl": 6}, True), ("ttl >= 6", {"ttl": 6}, True), ("ttl < 6", {"ttl": 6}, False), ("ttl <= 6", {"ttl": 6}, True),
    ("metric = 0", {}, False), ("metric = 0", {"metric": 0}, True), ("metric = 0.0", {}, True), ("metric = 7.1", {"metric": 7.1}, True), ("metric > -1", {"metric": 0}, True),
    ('foo = "bar"', {"attributes": {"foo": "bar"}}, True), ('foo =~ "b%"', {"attributes": {"foo": "bar"}}, False), ("foo = 7.1", {"attributes": {"foo": "7.1"}}, True), ("foo > 6", {"attributes": {"foo": "7x"}}, True), ("foo > 6", {"attributes": {"foo": "x"}}, False),
    ("host = nil", {}, True), ("host = nil", {"host": "h"}, False), ("metric = nil", {"metric": 1}, False), ("foo = nil", {"attributes": {"foo": "x"}}, False), ("not host = nil", {}, False),
    # one precedence level, left to right
    ('host = "h" or state = "x" and service = "s"', {"host": "h"}, False), ('host = "h" or (state = "x" and service = "s")', {"host": "h"}, True),
    ('not host = "a" and host = "b"', {"host": "b"}, True), ('not (host = "a" and host = "b")', {"host": "a"}, True),
]


@pytest.mark.parametrize("text, event, want", CASES)
def test_query(spark, text, event, want):
    assert (make_events(spark, [event]).filter(compile_query(text)).count() == 1) is want


@pytest.mark.parametrize("text", ["", "host", "host =", 'host = "a', "and", "(true", 'true and host = "a"', 'host != "a"', 'host = "a" host = "b"', 'host = "a"\nand true', "metric =~ nil"])
def test_query_errors(text):
    with pytest.raises(QuerySyntaxError):
        from tidemark.plans.query import parse

        parse(text)


def test_index(spark):
    e = make_events(spark, [{"host": "foo", "service": "bar", "time": 1, "ttl": 120}, {"host": "baz", "service": "bar", "time": 100, "ttl": 120}, {"host": "foo", "service": "bar", "time": 0, "ttl": 120, "metric": 5}, {"host": "x", "state": "expired"}])
    table = index.snapshot(e)
    assert sorted((r["host"], r["seq"]) for r in table.collect()) == [("baz", 1), ("foo", 2)]
    live, gone = index.expire(table, 180)
    assert [(r["host"], r["state"]) for r in gone.collect()] == [("foo", "expired")]
    assert [r["host"] for r in live.collect()] == ["baz"]
    assert index.query(table, 'host = "baz"').count() == 1
    assert index.query(table, "true", 1).count() == 1
    snap, changes = index.subscribe(table, index.changes(e), 'host = "foo"')
    assert (snap.count(), changes.count()) == (1, 2)
    topics = index.Topics()
    topics.publish("index", index.changes(e))
    assert topics.subscribe("index", 'host = "baz"').count() == topics.subscribe("index", 'host = "baz"').count() == 1


def test_expired_events_are_not_indexed(spark):
    e = make_events(spark, [{"host": "a", "time": 0}, {"host": "b", "state": "expired"}])
    assert [r["host"] for r in sinks.send_index().run(e, Context()).indexed.collect()] == ["a"]
