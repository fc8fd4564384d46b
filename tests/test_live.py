"""The live side: timers, index, subscriptions, transports, metrics, sources that resume."""

import json
import random
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark import metrics, operators as O, sinks, tester
from tidemark.functions import folds
from tidemark.functions import predicates as P
from tidemark.plans import index, rules
from tidemark.plans.stream import Context, by, create_forwarding_stream, create_stateful_stream, sdo, split
from tidemark.schema import make_events
from tidemark.sources import parquet_stream, wire
from tidemark.streaming import machines
from tidemark.streaming.clock import Timers, unix_time
from tidemark.streaming.state import scan
from tidemark.streaming.subscriptions import SubscriptionServer


def wait(true, seconds=20):
    end = time.monotonic() + seconds
    while not true() and time.monotonic() < end:
        time.sleep(0.02)
    assert true()


def test_timers():
    fired = []
    with Timers() as timers:
        timers.periodic(lambda: fired.append("p"), 0.02)
        timers.once(lambda: 1 / 0, 0.01)
        timers.once(lambda: fired.append("once"), 0.05)
        timers.once(lambda: fired.append("never"), 0.3, "lib")
        timers.remove("lib")
        wait(lambda: fired.count("p") >= 5 and "once" in fired)
        with pytest.raises(ValueError):
            timers.periodic(print, 0)
    n = len(fired)
    time.sleep(0.35)
    assert len(fired) == n and "never" not in fired and abs(unix_time() - time.time()) < 5


def test_live_index(spark, tmp_path):
    """Upserts touch only their buckets; what goes silent comes back as expired events on a stream."""
    live = index.LiveIndex(spark, str(tmp_path / "i"), buckets=4)
    rows = [{"seq": i, "host": f"h{i % 5}", "service": "s", "time": i, "ttl": 50, "metric": i} for i in range(20)]
    live.upsert(make_events(spark, rows[:10]), 0)
    first = live.manifest()["buckets"]
    live.upsert(make_events(spark, [rows[10]]), 1)
    second = live.manifest()["buckets"]
    assert sum(first[b] != second[b] for b in first) == 1
    live.upsert(make_events(spark, rows[11:]), 2)
    live.upsert(make_events(spark, [{"seq": 99, "host": "h0", "service": "s"}]), 2)  # the same batch again
    assert sorted((r["host"], r["seq"]) for r in live.table().collect()) == [(f"h{i}", 15 + i) for i in range(5)]
    live.expire(16 + 51)
    assert sorted(r["host"] for r in live.table().collect()) == ["h2", "h3", "h4"] or sorted(r["host"] for r in live.table().collect()) == ["h1", "h2", "h3", "h4"]
    query = live.expired_events().writeStream.format("memory").queryName("gone").trigger(availableNow=True).start()
    query.awaitTermination(60)
    gone = spark.table("gone").collect()
    assert {r["state"] for r in gone} == {"expired"} and "h0" in {r["host"] for r in gone}
    assert len(gone) + live.table().count() == 5
    live.expire(1000)
    assert live.table().count() == 0
    live.expire(1000)
    assert len(list((tmp_path / "i" / "manifest").glob("[0-9]*"))) <= 2


def test_subscription(spark):
    events = make_events(spark, [{"host": "a", "metric": 1}, {"host": "b", "metric": 2}])
    server = SubscriptionServer(lambda: events, port=0)

    def read(s, n):
        out = []
        while len(out) < n:
            head = s.recv(2)
            size = head[1] if head[1] < 126 else struct.unpack(">H", s.recv(2))[0]
            out.append(json.loads(s.recv(size)))
        return out

    with socket.create_connection(("127.0.0.1", server.port), timeout=60) as s:
        s.sendall(b"GET /index?subscribe=true&query=host%20%3D%20%22a%22 HTTP/1.1\r\nUpgrade: websocket\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\n\r\n")
        head = b""
        while b"\r\n\r\n" not in head:
            head += s.recv(1)
        assert b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in head  # the protocol's own example
        assert [r["metric"] for r in read(s, 1)] == [1.0]
        server.publish(make_events(spark, [{"host": "b", "metric": 3}, {"host": "a", "metric": 4}, {"host": "a", "metric": 5}]))
        assert [r["metric"] for r in read(s, 2)] == [4.0, 5.0]
    wait(lambda: not server.subscribers)
    for path, want in ((b"/index?query=true", b"200"), (b"/index?query=host", b"400"), (b"/x", b"404")):
        with socket.create_connection(("127.0.0.1", server.port), timeout=60) as s:
            s.sendall(b"GET " + path + b" HTTP/1.1\r\n\r\n")
            data = b""
            while part := s.recv(4096):
                data += part
            assert want in data.split(b"\r\n")[0]
            assert data.count(b'"host"') == (2 if want == b"200" else 0)
    server.close()


def test_connections_survive_a_peer_that_restarts():
    taken, stop = [], []

    def serve(server):
        while not stop:
            try:
                c, _ = server.accept()
            except OSError:
                return
            with c:
                while part := c.recv(4096):
                    taken.append(part)
                    if part.endswith(b"bye\n"):
                        break

    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]
    threading.Thread(target=serve, args=(server,), daemon=True).start()
    pool = sinks.Connections(tries=3, wait=0.01, queue=3)
    end = f"127.0.0.1:{port}"
    assert pool.send(end, [b"a\n", b"bye\n"]) == 0
    wait(lambda: b"".join(taken).endswith(b"bye\n"))
    time.sleep(0.1)
    assert pool.send(end, [b"b\n"]) == 0
    wait(lambda: b"b\n" in b"".join(taken))
    pool.close()
    stop.append(1)
    dead = "127.0.0.1:1"
    assert pool.send(dead, [b"1", b"2"]) == 2 and pool.send(dead, [b"3", b"4"]) == 3 and pool.dropped == 1


def test_mail_and_incidents_go_out_together(monkeypatch):
    sent = []

    class Server:
        def __init__(self, host, port, timeout):
            sent.append((host, port))

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def send_message(self, mail):
            sent.append(mail["To"])

    monkeypatch.setattr(sinks.smtplib, "SMTP", Server)
    sinks.send_mail([{"message": "m", "event": "{}", "extra": json.dumps({"server": "mail:25", "from": "a", "to": [t]})} for t in ("x", "y")])
    assert sent == [("mail", 25), "x", "y"]
    asked = []

    def take(request, timeout):
        asked.append(json.loads(request.data))
        if asked[-1]["incident_key"] == "bad":
            raise OSError("no")
        return open("/dev/null")

    monkeypatch.setattr(sinks, "urlopen", take)
    rows = [{"method": "pagerduty_trigger", "message": m, "event": "{}", "extra": "k"} for m in ("bad", "i", "i")]
    with pytest.raises(OSError):
        sinks.send_incidents(rows)
    assert [a["incident_key"] for a in asked].count("i") == 2


def test_instruments(spark, tmp_path):
    now = [100.0]
    own = metrics.Instruments(lambda: now[0])
    count, took, gauge = own.add_rate("in", "taken"), own.add_latency("wait"), own.add_gauge("queue")
    count(10)
    for i in range(101):
        took(i)
    gauge.set(5)
    gauge.incr()
    gauge.decr(2)
    now[0] = 105.0
    rows = {r["service"]: r for r in own.snapshot()}
    assert rows["in"]["metric"] == 2.0 and rows["in"]["description"] == "taken" and rows["queue"]["metric"] == 4.0
    assert [rows[f"wait {p:.6f}"]["metric"] for p in (0, 0.5, 1)] == [0, 50, 100]
    assert rows["memory vm"]["metric"] >= rows["memory rss"]["metric"] > 10
    assert all(r["tags"] == [metrics.TAG] and r["state"] == "ok" and r["ttl"] == 60 and r["time"] == 105 for r in rows.values())
    now[0] = 110.0
    rows = {r["service"]: r for r in own.snapshot()}
    assert rows["in"]["metric"] == 0 and "wait 0.000000" not in rows
    write = metrics.emit(spark, own.snapshot, str(tmp_path / "m"))
    now[0] = 115.0
    write()
    got = parquet_stream(spark, str(tmp_path / "m")).writeStream.format("memory").queryName("own_metrics").trigger(availableNow=True).start()
    got.awaitTermination(60)
    assert {r["service"] for r in spark.table("own_metrics").collect()} >= {"in", "queue", "memory rss"}


def test_reservoir():
    r = metrics.Reservoir(100, seed=1)
    for i in range(10_000):
        r.add(i)
    assert len(r.values) == 100 and 3000 < sum(r.values) / 100 < 7000
    r.take()
    assert r.take() == []


PUSHES = {
    "stateful": lambda: by(["service"], create_stateful_stream(lambda s, e: [s.update(n=s["n"] + 1), [e | {"metric": float(s["n"])}]][1], lambda: {"n": 0})),
    "forwarding": lambda: create_forwarding_stream(lambda e, forward: [forward(e | {"state": str(i)}) for i in range(2)] if e["service"] == "a" else None),
}


@pytest.mark.parametrize("name", PUSHES)
def test_own_nodes(spark, tmp_path, name):
    events = make_events(spark, [{"seq": i, "time": i, "service": "ab"[i % 2], "metric": i} for i in range(10)])
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    want = sorted((r["seq"], r["state"] or "", r["metric"]) for r in PUSHES[name]().apply(events).collect())
    query = PUSHES[name]().apply(parquet_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName(f"own_{name}").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["seq"], r["state"] or "", r["metric"]) for r in spark.table(f"own_{name}").collect()) == want
    assert want == ([(i, "", float(i // 2 + 1)) for i in range(10)] if name == "stateful" else [(i, s, float(i)) for i in range(0, 10, 2) for s in "01"])


def test_forwarding_needs_no_exchange(spark):
    """Its events stay where they lie: no task gets them all, and it may stand before sinks of a batch."""
    program = PUSHES["forwarding"]()
    events = make_events(spark, [{"seq": i, "service": "a"} for i in range(10)]).repartition(5)
    plan = program.apply(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and program.stateless
    assert program.apply(events).count() == 20


def test_events_of_arrow_batches():
    """The same values as one by one, in slices too, with nulls inside and instead of lists and maps."""
    import pyarrow as pa

    from tidemark.streaming.state import events, plain

    tags, maps = [["a", None], [], None, ["b"]], [[("k", "1"), ("l", None)], None, [], [("m", "2")]]
    columns = {"seq": pa.array([1, 2, 3, 4]), "time": pa.array([None, 1, 2, None]), "host": pa.array(["x", None, "", "y"]), "ttl": pa.array([1.5, 2, 3, 4], pa.float32()), "flag": pa.array([True, None, False, True])}
    columns |= {"tags": pa.array(tags, pa.list_(pa.string())), "attributes": pa.array(maps, pa.map_(pa.string(), pa.string())), "none": pa.nulls(4, pa.string())}
    batch = pa.RecordBatch.from_pydict(columns)
    for b in (batch, batch.slice(1, 2), batch.slice(3), batch.slice(0, 0)):
        assert list(events(b)) == [plain(r) for r in b.to_pylist()]


def test_each_batch_refuses_state(spark, tmp_path):
    e = make_events(spark, [{"host": "h", "service": "s", "metric": 5, "state": "bad"}])
    mail = sinks.email("m", "a", "b")
    for program in (O.changed_state() >> mail, by(["host"], O.counter()) >> mail, sdo(O.stable(1)) >> mail, split([(P.above(1), O.throttle(1, 1))]) >> mail):
        with pytest.raises(ValueError):
            sinks.each_batch(program)(e, 0)
    seen = []
    for program in (O.above(1) >> mail, by(["host"], O.scale(2)) >> mail, split([(P.above(1), O.set_state("x"))]) >> sdo(mail, O.prn())):
        sinks.each_batch(program, lambda r: seen.append(r.filter("method = 'email'").count()))(e, 0)
    assert seen == [1, 1, 1]
    path = tmp_path / "r.py"
    text = "from tidemark import operators as O, sinks\n\ndef rules():\n    return O.above({}) >> sinks.email('m', 'a', 'b')\n"
    path.write_text(text.format(1))
    current = tester.RulesFile(str(path))
    run = sinks.each_batch(current, lambda r: seen.append(r.count()))
    run(e, 0)
    path.write_text(text.format(100))
    run(e, 1)
    path.write_text("nonsense (")
    run(e, 2)
    assert seen[3:] == [1, 0, 0] and current.error is not None


def test_prn_keeps_events_and_prints(spark, capfd):
    e = make_events(spark, [{"host": "a"}, {"host": "b"}])
    got = (O.prn("> ") >> O.set_state("x")).run(e)
    assert sorted(r["host"] for r in got.events.collect()) == ["a", "b"]
    assert sorted(r["message"] for r in got.reports.collect()) == ['> {"host":"a","tags":[]}', '> {"host":"b","tags":[]}'] or got.reports.count() == 2
    assert tester.run(e, O.prn() >> sinks.send_index())["reports"] == []


@pytest.mark.parametrize("raw", [b"\x32\x03\x0a\x01x", b"\x32\x02\x22\x00" + b"\x10\x01\x30\x05", b"\x32\x03\x78\x05\x00", b"\x12\x01x"])
def test_wrong_wire_types(spark, raw):
    with pytest.raises(wire.WireError):
        wire.decode(raw)
    good = wire.encode({"events": [{"host": "x"}, {"host": "y"}, {"host": "z"}]})
    got = wire.decode_messages(spark.createDataFrame([(3, raw), (4, good)], "seq long, message binary")).orderBy("seq").collect()
    assert [r["host"] for r in got] == ["x", "y", "z"] and len({r["seq"] for r in got}) == 3


def test_network_resumes_from_its_log(tmp_path):
    def send(port, messages):
        with socket.create_connection(("127.0.0.1", port)) as s:
            for m in messages:
                s.sendall(wire.frame(m))
                head = s.recv(4)
                yield wire.decode(s.recv(struct.unpack(">I", head)[0]))

    options = {"port": "0", "log": str(tmp_path)}
    reader = wire.NetworkReader(options)
    acks = list(send(reader.listener.port, [{"events": [{"host": "a"}]}, {"query": {"string": "true"}}, {"events": [{"host": "b"}]}]))
    assert acks == [{"ok": True}, {"ok": False, "error": "queries are not supported"}, {"ok": True}]
    reader.commit({"next": 1})
    again = wire.NetworkReader(options)
    assert again.latestOffset() == {"next": 2}
    rows = [r for p in again.partitions({"next": 1}, {"next": 2}) for r in again.read(p)]
    assert [wire.decode(r[1])["events"][0]["host"] for r in rows] == ["b"]
    with pytest.raises(RuntimeError):
        wire.NetworkReader({"port": "0"}).partitions({"next": 1}, {"next": 2})
    many = wire.Log(str(tmp_path / "m"))
    for i in range(2 * wire.Log.SEGMENT + 1):
        many.add(i, b"x")
    many.drop_before(wire.Log.SEGMENT + 5)
    assert min(many.read()) == wire.Log.SEGMENT and many.first_unused() == 2 * wire.Log.SEGMENT + 1


def live_rows(seed, n=120):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 1, 5, 40])
        out.append({"seq": i, "time": t, "host": f"h{rng.randint(0, 4)}", "service": rng.choice("ab"), "metric": rng.choice([None, 1.5, -2.0, float(rng.randint(0, 9))]), "state": rng.choice(["ok", "critical", "critical", "expired"]), "ttl": rng.choice([None, 3.0, 20.0, 100.0])})
    return out


@pytest.mark.parametrize("ctx", [Context(), Context(ordered=False), Context(clock=400)])
def test_live_plans_agree_with_machines(spark, ctx):
    """Both outputs, with their order, under expiry, replacement, missing metrics, events that are over when they come."""
    data = live_rows(1)
    if not ctx.ordered:
        random.Random(2).shuffle(data)
        data = [r | {"seq": i} for i, r in enumerate(data)]
    events = make_events(spark, data)
    show = lambda df, *order: [tuple(r[c] for c in ("seq", "time", "host", "service", "state")) + (None if r["metric"] is None else round(r["metric"], 6),) for r in df.orderBy("seq", *order).collect()]
    for fold in (folds.mean, folds.maximum, folds.product, folds.difference) if ctx.clock is None and ctx.ordered else (folds.sum, folds.minimum):
        plan, after = O.coalesce(fold).lower(events, ctx)
        machine = scan(events, ctx, machines.Coalesce(fold.name, fold.python, ctx.clock))
        assert sorted(show(plan), key=str) == sorted(show(machine), key=str), fold.name
        numbers = [tuple(r) for r in plan.groupBy("seq").agg(F.count("*"), F.min(after.order[1]), F.max(after.order[1])).collect()]
        assert all(n == 1 or (lo, hi) == (0, 1) for _, n, lo, hi in numbers) and any(n == 2 for _, n, _, _ in numbers)

    def fold(es):
        return es[0] | {"state": "critical" if sum(e["state"] == "critical" for e in es) >= 3 else "ok"}

    machine = scan(events, ctx, machines.Coalesce("critical", fold, ctx.clock, True))
    assert sorted(show(rules.max_critical_hosts(3).lower(events, ctx)[0]), key=str) == sorted(show(machine), key=str)


def test_marking_plans_agree_with_machines(spark):
    events = make_events(spark, live_rows(5))
    show = lambda df: sorted((r["seq"], r["state"]) for r in df.collect())
    assert show(O.throttle(2, 10).apply(events)) == show(scan(events, Context(), machines.Throttle(2, 10)))
    marked = events.withColumn("__trigger", F.coalesce(P.above(5), F.lit(False))).withColumn("__cancel", F.coalesce(P.under(1), F.lit(False)))
    for dt in (0, 30):
        want = show(scan(marked, Context(), machines.Hysteresis(dt), ["__trigger", "__cancel"]))
        assert show(rules.stable_metric(dt, P.above(5), P.under(1)).apply(events)) == want
        late = events.withColumn("time", F.when(F.col("seq") % 7 == 0, F.col("time") - 30).otherwise(F.col("time")))
        marked_late = late.withColumn("__trigger", F.coalesce(P.above(5), F.lit(False))).withColumn("__cancel", F.coalesce(P.under(1), F.lit(False)))
        assert show(rules.stable_metric(dt, P.above(5), P.under(1)).apply(late)) == show(scan(marked_late, Context(), machines.Hysteresis(dt), ["__trigger", "__cancel"]))
    for fold in (folds.sum, folds.mean, folds.minimum, folds.product, folds.difference):
        for dt in (1, 4) if fold is folds.sum else (20,):
            got = O.moving_time_window(dt, fold).apply(events).orderBy("seq").collect()
            want = O.moving_time_window(dt, fold).apply(events, Context(ordered=False)).orderBy("seq").collect()
            assert [(r["seq"], r["time"], r["host"], round(r["metric"], 6)) for r in got] == [(r["seq"], r["time"], r["host"], round(r["metric"], 6)) for r in want]


def test_live_plans_broadcast_nothing(spark, tmp_path):
    """All sides of their joins grow with the input; Spark takes a small file's for small."""
    make_events(spark, live_rows(3)).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    for program in (O.coalesce(folds.count), by(["service"], O.coalesce(folds.maximum)), rules.max_critical_hosts(3)):
        assert "Broadcast" not in program.apply(events)._jdf.queryExecution().executedPlan().toString()
