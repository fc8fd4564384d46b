import json
import socket
import struct
import threading
import time

import pytest

from tidemark import metrics, operators as O, sinks, tester
from tidemark.functions import exprs
from tidemark.plans.stream import Stream
from tidemark.schema import make_events
from tidemark.sources import json_events, wire
from tidemark.sources.files import json_text

EVENT = {"time": -5, "state": "ok", "service": "sérvice", "host": "h", "description": "d", "tags": ["a", "b"], "ttl": 60.0, "attributes": [{"key": "k", "value": "v"}, {"key": "bare"}], "metric_sint64": -7}


def test_wire_round_trip():
    raw = wire.encode({"ok": True, "error": "e", "events": [EVENT, {"metric_d": 1.5}, {"metric_f": 2.5, "metric_d": 1.0}]})
    got = wire.decode(raw)
    assert got["ok"] is True and got["error"] == "e" and got["events"][0] == EVENT
    assert [wire.row(e)["metric"] for e in got["events"]] == [-7.0, 1.5, 2.5]
    assert wire.decode(b"\x98\x06\x05" + raw)["error"] == "e"  # an unknown field
    for bad in (raw[:-3], b"\xff" * 12, b"\x0b"):
        with pytest.raises(wire.WireError):
            wire.decode(bad)


def test_decode_messages(spark):
    rows = [(0, wire.encode({"events": [EVENT, {"host": "x"}]})), (1, b"\xff\xff"), (2, b"")]
    got = wire.decode_messages(spark.createDataFrame(rows, "seq long, message binary")).collect()
    assert [(r["host"], r["metric"], r["tags"], r["attributes"]) for r in got] == [("h", -7.0, ["a", "b"], {"k": "v", "bare": None}), ("x", None, [], {})]


@pytest.mark.parametrize("protocol", ["tcp", "udp"])
def test_network(spark, protocol):
    reader = wire.NetworkReader({"port": "0", "protocol": protocol})
    port = reader.listener.port
    if protocol == "tcp":
        with socket.create_connection(("127.0.0.1", port)) as s:
            s.sendall(wire.frame({"events": [EVENT]}))
            head = s.recv(4)
            assert wire.decode(s.recv(struct.unpack(">I", head)[0])) == {"ok": True}
            s.sendall(struct.pack(">I", wire.MAX_FRAME))
            assert s.recv(1) == b""  # too large: closed
    else:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.sendto(wire.encode({"events": [EVENT]}), ("127.0.0.1", port))
    for _ in range(100):
        if reader.latestOffset()["next"]:
            break
        time.sleep(0.05)
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert wire.decode(rows[0][1])["events"] == [EVENT]
    reader.commit(end)
    assert not reader.listener.messages


def test_json_events(spark, tmp_path):
    rows = [{"host": "b", "time": 5, "metric": 1, "zone": "z"}, {"host": "a", "time": 2, "tags": ["t"], "metric": 2.5}, {"host": "c", "time": 5}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    for df in (json_events(spark, str(tmp_path / "a.json")), json_events(spark, str(tmp_path / "b.json")), json_text(spark, json.dumps(rows))):
        got = df.orderBy("seq").collect()
        assert [r["host"] for r in got] == ["a", "b", "c"]
        assert got[1]["attributes"] == {"zone": "z"} and got[0]["tags"] == ["t"] and got[0]["metric"] == 2.5


def test_event_functions(spark):
    e = make_events(spark, [{"host": "h", "metric": 1.5, "ttl": 5, "tags": ["t"], "attributes": {"k": "v"}}, {}])
    got = [r[0] for r in e.orderBy("seq").select(exprs.json_str()).collect()]
    assert [json.loads(g) for g in got] == [{"host": "h", "metric": 1.5, "tags": ["t"], "k": "v"}, {}]
    assert [r[0] for r in e.orderBy("seq").select(exprs.metric_str()).collect()] == ["1.500000", "nil"]
    row = e.limit(1).select(exprs.has_field("host"), exprs.has_field("service"), exprs.has_field("k"), exprs.field_str("zz"), exprs.sha1_base64(exprs.field_str("host")), exprs.conj(exprs.F.col("tags"), exprs.F.lit("n"))).first()
    assert row[:4] == (True, False, True, "nil") and row[5] == ["t", "n"] and len(row[4]) == 28
    assert exprs.parse_uri("/index?subscribe=true&query=a%20%3D+b") == ("/index", {"subscribe": "true", "query": "a = b"})


def test_transports(spark):
    server = socket.create_server(("127.0.0.1", 0))
    taken = []

    def serve():
        for _ in range(2):
            c, _ = server.accept()
            with c:
                data = b""
                while part := c.recv(4096):
                    data += part
                taken.append(data)

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    port = server.getsockname()[1]
    e = make_events(spark, [{"host": "h x", "service": "s", "metric": 1.5, "time": 9}])
    for program in (sinks.send_graphite("127.0.0.1", port), sinks.forward("127.0.0.1", port)):
        sinks.deliver(program.run(e).reports.coalesce(1))
    thread.join(20)
    assert taken[0] == b"h_x.s 1.5 9\n"
    assert wire.decode(taken[1][4:])["events"][0]["host"] == "h x"
    seen = []
    sinks.each_batch(sinks.pagerduty_resolve("k"), lambda r: seen.extend(r.collect()))(e, 0)
    assert [(r["method"], r["extra"], r["message"]) for r in seen] == [("pagerduty_resolve", "k", "h x s")]
    sinks.printer("> ")(e, 0)


def test_metrics(spark):
    rows = metrics.progress_events({"name": "q", "processedRowsPerSecond": 5.0, "durationMs": {"addBatch": 7}, "stateOperators": [{"numRowsTotal": 3}]}, 10)
    assert {r["service"]: r["metric"] for r in rows} == {"stream rate": 5.0, "in rate": 0.0, "latency addBatch": 7.0, "state rows 0": 3.0}
    assert all(r["tags"] == [metrics.TAG] and r["ttl"] == 60 for r in rows)
    e = make_events(spark, [{"metric": float(i)} for i in range(101)])
    assert [r["metric"] for r in metrics.latency_snapshot(e, "metric").orderBy("p").collect()] == [0, 50, 95, 99, 100]
    assert metrics.rate_snapshot(e, 10).first()["metric"] == 10.1
    assert metrics.memory_event(1)["metric"] > 0


def test_rules_file(spark, tmp_path):
    (tmp_path / "r.py").write_text("from tidemark import operators as O, sinks\n\ndef rules():\n    return O.above(1) >> sinks.send_index()\n")
    program = tester.load_rules(str(tmp_path / "r.py"))
    assert isinstance(program, Stream)
    e = make_events(spark, [{"host": "a", "metric": 2, "time": 1, "ttl": 5}, {"host": "b", "metric": 0, "time": 2}])
    assert [x["event"]["host"] for x in tester.run(e, program)["index"]] == ["a"]
    live, gone = tester.index_after(e, program, 100)
    assert (live.count(), gone.count()) == (0, 1)
    assert O.prn().apply(e).count() == 2
