"""Live subscriptions to the index: what matches now, then changes as they come, over a websocket.

``GET /index?subscribe=true&query=...`` with an upgrade to a websocket gives a text message for each event, as JSON.
Without ``subscribe`` the answer ends after what matches now; without an upgrade it comes as JSON lines.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import queue
import socket
import struct
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import json_str, parse_uri
from tidemark.plans.query import QuerySyntaxError, compile_query

log = logging.getLogger(__name__)
#: Fixed value: what a websocket server adds to the client's key.
HANDSHAKE = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
#: Messages that may wait for one subscriber; a slower one misses what comes then.
MAX_WAITING = 200_000


def text_frame(text: str) -> bytes:
    raw = text.encode()
    n = len(raw)
    head = struct.pack(">BB", 0x81, n) if n < 126 else struct.pack(">BBH", 0x81, 126, n) if n < 65536 else struct.pack(">BBQ", 0x81, 127, n)
    return head + raw


class Subscriber:
    def __init__(self, text: str):
        self.predicate = compile_query(text)
        self.waiting: queue.Queue = queue.Queue(MAX_WAITING)
        self.missed = 0

    def put(self, line: str) -> None:
        try:
            self.waiting.put_nowait(line)
        except queue.Full:
            self.missed += 1


class SubscriptionServer:
    """``table`` gives the index as it is; ``publish`` is for ``foreachBatch``, after the index has taken the batch."""

    def __init__(self, table: Callable[[], DataFrame], host: str = "127.0.0.1", port: int = 5556):
        self.table = table
        self.subscribers: list[Subscriber] = []
        self.lock = threading.Lock()
        self.socket = socket.create_server((host, port))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self._accept, daemon=True).start()

    def publish(self, batch: DataFrame, epoch: int = 0) -> None:
        """One pass over the batch for all subscribers; rows that none asks for stay on the executors."""
        with self.lock:
            present = list(self.subscribers)
        if not present:
            return
        wants = F.array(*(F.coalesce(s.predicate, F.lit(False)) for s in present))
        rows = batch.select("seq", json_str().alias("j"), wants.alias("w")).filter(F.array_contains("w", True)).orderBy("seq")
        for row in rows.toLocalIterator():
            for s, wanted in zip(present, row["w"]):
                if wanted:
                    s.put(row["j"])

    def close(self) -> None:
        self.socket.close()

    def _accept(self) -> None:
        while True:
            try:
                connection, _ = self.socket.accept()
            except OSError:
                return
            threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection: socket.socket) -> None:
        subscriber = None
        with connection:
            try:
                head = b""
                while b"\r\n\r\n" not in head and len(head) < 65536 and (part := connection.recv(4096)):
                    head += part
                lines = head.decode("latin-1").split("\r\n")
                path, params = parse_uri((lines[0].split(" ") + ["", ""])[1])
                headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
                if path != "/index":
                    connection.sendall(b"HTTP/1.1 404 Not Found\r\nContent-Length: 0\r\n\r\n")
                    return
                try:
                    subscriber = Subscriber(params.get("query", "true"))
                except QuerySyntaxError as e:
                    body = str(e).encode()
                    connection.sendall(b"HTTP/1.1 400 Bad Request\r\nContent-Length: %d\r\n\r\n" % len(body) + body)
                    return
                web = headers.get("upgrade", "").lower() == "websocket"
                if web:
                    accept = base64.b64encode(hashlib.sha1((headers.get("sec-websocket-key", "") + HANDSHAKE).encode()).digest()).decode()
                    connection.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
                else:
                    connection.sendall(b"HTTP/1.1 200 OK\r\nContent-Type: application/x-ndjson\r\nConnection: close\r\n\r\n")
                send = (lambda t: connection.sendall(text_frame(t))) if web else (lambda t: connection.sendall(t.encode() + b"\n"))
                live = params.get("subscribe") == "true"
                if live:  # from before the snapshot on, so that nothing falls between the two
                    with self.lock:
                        self.subscribers.append(subscriber)
                for row in self.table().filter(subscriber.predicate).select(json_str().alias("j")).toLocalIterator():
                    send(row["j"])
                while live:
                    try:
                        send(subscriber.waiting.get(timeout=1))
                    except queue.Empty:
                        if self._hung_up(connection):
                            return
                if web:
                    connection.sendall(b"\x88\x00")
            except OSError:
                pass
            except Exception:
                log.exception("subscription failed")
            finally:
                with self.lock:
                    if subscriber in self.subscribers:
                        self.subscribers.remove(subscriber)

    @staticmethod
    def _hung_up(connection: socket.socket) -> bool:
        connection.setblocking(False)
        try:
            got = connection.recv(4096)
            return not got or got[0] & 0x0F == 8  # closed, or a closing frame
        except BlockingIOError:
            return False
        finally:
            connection.setblocking(True)
