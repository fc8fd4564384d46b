"""The binary message format: protobuf messages of events, framed by a 4-byte big-endian length on TCP.

``decode`` and ``encode`` are small protobuf codecs driven by the field table; batches of
messages are decoded on executors. ``NetworkSource`` is a streaming data source over TCP or UDP.
"""

from __future__ import annotations

import os
import socket
import struct
import threading
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.schema import as_events

#: Fields of the messages, by number.
EVENT_FIELDS = {1: ("time", "int64"), 2: ("state", "string"), 3: ("service", "string"), 4: ("host", "string"), 5: ("description", "string"), 7: ("tags", "string*"), 8: ("ttl", "float"), 9: ("attributes", "attribute*"), 13: ("metric_sint64", "sint64"), 14: ("metric_d", "double"), 15: ("metric_f", "float")}
ATTRIBUTE_FIELDS = {1: ("key", "string"), 2: ("value", "string")}
QUERY_FIELDS = {1: ("string", "string")}
MESSAGE_FIELDS = {2: ("ok", "bool"), 3: ("error", "string"), 5: ("query", "query"), 6: ("events", "event*")}
TABLES = {"event": EVENT_FIELDS, "attribute": ATTRIBUTE_FIELDS, "query": QUERY_FIELDS, "msg": MESSAGE_FIELDS}
#: How each type of field is laid out.
WIRE_TYPES = {"int64": 0, "sint64": 0, "bool": 0, "double": 1, "string": 2, "float": 5}
#: Bits of ``seq`` for the place of an event in its message; a frame can't hold so many.
PLACE_BITS = 20
#: Largest frame on TCP, and largest datagram on UDP.
MAX_FRAME, MAX_DATAGRAM = 1536 * 1024, 4096
ROW = "time bigint, host string, service string, state string, description string, metric double, ttl float, tags array<string>, attributes map<string,string>"


class WireError(ValueError):
    pass


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("broken number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def decode(data: bytes, kind: str = "msg") -> dict:
    """A message as a dict; unknown fields are skipped."""
    out: dict = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise WireError(f"wire type {wire}")
            if at + size > len(data):
                raise WireError("cut off")
            raw, at = data[at : at + size], at + size
        if tag >> 3 not in TABLES[kind]:
            continue
        name, type_ = TABLES[kind][tag >> 3]
        base = type_.rstrip("*")
        if wire != WIRE_TYPES.get(base, 2):
            raise WireError(f"{name} has wire type {wire}")
        if base in TABLES:
            value = decode(raw, base)
        elif base == "string":
            value = raw.decode("utf-8", "replace")
        elif base == "double":
            value = struct.unpack("<d", raw)[0]
        elif base == "float":
            value = struct.unpack("<f", raw)[0]
        elif base == "bool":
            value = bool(raw)
        elif base == "sint64":
            value = (raw >> 1) ^ -(raw & 1)
        else:
            value = raw - (1 << 64) if raw >> 63 else raw
        if type_.endswith("*"):
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(message: dict, kind: str = "msg") -> bytes:
    out = bytearray()
    for number, (name, type_) in TABLES[kind].items():
        value = message.get(name)
        if kind == "event" and name == "metric_d" and value is None:
            value = message.get("metric")
        if value is None:
            continue
        base = type_.rstrip("*")
        if base == "attribute" and isinstance(value, dict):
            value = [{"key": k, "value": v} for k, v in value.items()]
        for v in value if type_.endswith("*") else [value]:
            if base in ("int64", "sint64", "bool"):
                v = (int(v) << 1) ^ (int(v) >> 63) if base == "sint64" else int(v)
                out += _number(number << 3) + _number(v)
            elif base in ("double", "float"):
                out += _number(number << 3 | (1 if base == "double" else 5)) + struct.pack("<d" if base == "double" else "<f", v)
            else:
                raw = encode(v, base) if base in TABLES else v.encode()
                out += _number(number << 3 | 2) + _number(len(raw)) + raw
    return bytes(out)


def frame(message: dict) -> bytes:
    raw = encode(message)
    return struct.pack(">I", len(raw)) + raw


def row(event: dict) -> dict:
    """An event message as a row; the metric is the float one, else the integer, else the double."""
    number = next((float(event[k]) for k in ("metric_f", "metric_sint64", "metric_d") if k in event), None)
    return {c: event.get(c) for c in ("time", "host", "service", "state", "description", "ttl")} | {"metric": number, "tags": event.get("tags", []), "attributes": [(a.get("key", ""), a.get("value")) for a in event.get("attributes", [])]}


def decode_messages(df: DataFrame, message: str = "message", seq: str = "seq") -> DataFrame:
    """Events of a table of binary messages; broken messages give none.

    An event's ``seq`` is the message's, and its place in it: events of a message stay in order.
    """
    kinds = pa.schema([("time", pa.int64()), ("host", pa.string()), ("service", pa.string()), ("state", pa.string()), ("description", pa.string()), ("metric", pa.float64()), ("ttl", pa.float32()), ("tags", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("seq", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for number, raw in zip(b.column("seq").to_pylist(), b.column("message").to_pylist()):
                try:
                    rows += [row(e) | {"seq": (number << PLACE_BITS) + i} for i, e in enumerate(decode(raw).get("events", []))]
                except WireError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)

    out = df.select(F.col(message).alias("message"), F.col(seq).cast("long").alias("seq")).mapInArrow(run, ROW + ", seq bigint")
    return as_events(out, **{c: c for c in ("seq", "time", "host", "service", "state", "description", "metric", "ttl", "tags", "attributes")})


def encode_messages(events: DataFrame) -> DataFrame:
    """A message for each event: seq, message (binary), as ``decode_messages`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{k: v for k, v in r.items() if k != "seq" and v is not None} for r in b.to_pylist()]
            raw = [encode({"events": [r | {"attributes": dict(r.get("attributes", []))}]}) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(raw, pa.binary())], names=["seq", "message"])

    return events.select("seq", "time", "host", "service", "state", "description", "metric", "ttl", "tags", "attributes").mapInArrow(run, "seq bigint, message binary")


class Log:
    """Accepted messages on disk, in segments by their first number, so that a restart knows what was acknowledged.

    The folder belongs to the driver and must outlive it.
    """

    SEGMENT = 1000

    def __init__(self, path: str):
        self.path, self.file = Path(path), None
        self.path.mkdir(parents=True, exist_ok=True)

    def read(self) -> dict[int, bytes]:
        out = {}
        for segment in sorted(self.path.glob("*.log")):
            data, at = segment.read_bytes(), 0
            while at + 12 <= len(data):
                number, size = struct.unpack_from(">QI", data, at)
                if at + 12 + size > len(data):
                    break  # not acknowledged
                out[number] = data[at + 12 : at + 12 + size]
                at += 12 + size
        return out

    def first_unused(self) -> int:
        """One past the last number; kept in the names of segments, also when all messages are gone."""
        return max([n + 1 for n in self.read()] + [int(s.stem) for s in self.path.glob("*.log")], default=0)

    def add(self, number: int, raw: bytes) -> None:
        if self.file is None or number % self.SEGMENT == 0:
            if self.file:
                self.file.close()
            self.file = open(self.path / f"{number:020d}.log", "ab")  # noqa: SIM115
        self.file.write(struct.pack(">QI", number, len(raw)) + raw)
        self.file.flush()
        os.fsync(self.file.fileno())

    def drop_before(self, number: int) -> None:
        segments = sorted(self.path.glob("*.log"))
        for own, after in zip(segments, segments[1:]):
            if int(after.stem) <= number:
                own.unlink()


class Listener:
    """Takes messages on TCP or UDP and keeps them until they are committed.

    TCP messages are acknowledged when taken, with a log only once they are on disk. Queries are refused.
    """

    def __init__(self, host: str, port: int, protocol: str, log: str | None = None):
        self.log = Log(log) if log else None
        self.messages: dict[int, bytes] = self.log.read() if self.log else {}
        self.next = self.log.first_unused() if self.log else 0
        self.lock = threading.Lock()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM if protocol == "udp" else socket.SOCK_STREAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self.datagrams if protocol == "udp" else self.accept, daemon=True).start()

    def add(self, raw: bytes) -> None:
        with self.lock:
            if self.log:
                self.log.add(self.next, raw)
            self.messages[self.next] = raw
            self.next += 1

    def datagrams(self) -> None:
        while True:
            self.add(self.socket.recv(MAX_DATAGRAM))

    def accept(self) -> None:
        self.socket.listen()
        while True:
            connection, _ = self.socket.accept()
            threading.Thread(target=self.read, args=(connection,), daemon=True).start()

    def read(self, connection: socket.socket) -> None:
        with connection, connection.makefile("rb") as f:
            while len(head := f.read(4)) == 4:
                size = struct.unpack(">I", head)[0]
                if size + 4 > MAX_FRAME or len(raw := f.read(size)) < size:
                    return
                try:
                    asks = "query" in decode(raw)
                except WireError:
                    asks = False  # decoding leaves it out
                if asks:
                    connection.sendall(frame({"ok": False, "error": "queries are not supported"}))
                    continue
                self.add(raw)
                connection.sendall(frame({"ok": True}))


class Messages(InputPartition):
    def __init__(self, rows: list[tuple[int, bytes]]):
        self.rows = rows


class NetworkReader(DataSourceStreamReader):
    """Options: host, port, protocol (tcp or udp), partitions (of a micro-batch), log (a folder; without, a query can't be resumed)."""

    def __init__(self, options: dict):
        self.listener = Listener(options.get("host", "127.0.0.1"), int(options.get("port", 5555)), options.get("protocol", "tcp"), options.get("log"))
        self.split = int(options.get("partitions", 8))

    def initialOffset(self) -> dict:
        return {"next": min(self.listener.messages, default=self.listener.next)}

    def latestOffset(self) -> dict:
        return {"next": self.listener.next}

    def partitions(self, start: dict, end: dict) -> list[Messages]:
        with self.listener.lock:
            if start["next"] > self.listener.next or end["next"] > self.listener.next:
                raise RuntimeError("the query resumes behind what this listener has taken: messages of an earlier run are only kept with the option log")
            rows = [(i, self.listener.messages[i]) for i in range(start["next"], end["next"]) if i in self.listener.messages]
        step = max(1, -(-len(rows) // self.split))
        return [Messages(rows[lo : lo + step]) for lo in range(0, len(rows), step)] or [Messages([])]

    def commit(self, end: dict) -> None:
        with self.listener.lock:
            for i in [i for i in self.listener.messages if i < end["next"]]:
                del self.listener.messages[i]
            if self.listener.log:
                self.listener.log.drop_before(end["next"])

    def read(self, partition: Messages) -> Iterator[tuple]:
        yield from partition.rows


class NetworkSource(DataSource):
    """``spark.readStream.format("tidemark-network").option("port", 5555)``: rows of seq and message, for ``decode_messages``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark-network"

    def schema(self) -> str:
        return "seq bigint, message binary"

    def streamReader(self, schema) -> NetworkReader:
        return NetworkReader(self.options)


def network_events(spark: SparkSession, host: str = "127.0.0.1", port: int = 5555, protocol: str = "tcp", log: str | None = None) -> DataFrame:
    spark.dataSource.register(NetworkSource)
    options = {"host": host, "port": str(port), "protocol": protocol} | ({"log": log} if log else {})
    return decode_messages(spark.readStream.format("tidemark-network").options(**options).load())
