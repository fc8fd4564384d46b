"""Sinks. A program run in batch leaves what it would send in a reports table; a transport sends it.

Reports: method, time, message, extra, event (JSON). Every sink ends its chain.
"""

from __future__ import annotations

import json
import logging
import smtplib
import socket
import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.message import EmailMessage
from functools import partial
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import field_str, json_str, report_json
from tidemark.plans.stream import Node, Stream, expired_now, hidden
from tidemark.schema import FIELDS


log = logging.getLogger(__name__)


def graphite_line() -> Column:
    """``host.service value time``, as plain-text Carbon takes it; other marks become underscores."""
    name = lambda f: F.regexp_replace(field_str(f), r"[^A-Za-z0-9_-]+", "_")
    return F.concat_ws(" ", F.concat_ws(".", name("host"), name("service")), F.coalesce("metric", F.lit(0.0)).cast("string"), F.coalesce("time", F.lit(0)).cast("string"))


@dataclass(frozen=True)
class Report(Node):
    stateless = True
    method: str
    message: Column
    extra: str

    def lower(self, df, ctx):
        ctx.reports.append(df.select(F.lit(self.method).alias("method"), "time", self.message.alias("message"), F.lit(self.extra).alias("extra"), report_json().alias("event"), "seq"))
        return df.filter(F.lit(False)).select(hidden(ctx)), ctx


@dataclass(frozen=True)
class Index(Node):
    stateless = True

    def lower(self, df, ctx):
        ctx.indexed.append(df.filter(~expired_now(ctx)).select(FIELDS))
        return df.filter(F.lit(False)).select(hidden(ctx)), ctx


def _report(method: str, extra: str, message: Column | None = None) -> Stream:
    return Stream((Report(method, F.lit(method) if message is None else message, extra),))


def send_index() -> Stream:
    """Index events that have not expired."""
    return Stream((Index(),))


def send_graphite(host: str, port: int) -> Stream:
    return _report("graphite", f"{host}:{port}", graphite_line())


def forward(host: str, port: int) -> Stream:
    return _report("forward", f"{host}:{port}", json_str())


def email(server: str, sender: str, to: str | list[str]) -> Stream:
    to = [to] if isinstance(to, str) else to
    return _report("email", json.dumps({"server": server, "from": sender, "to": to}), F.concat_ws(" ", field_str("host"), field_str("service"), field_str("state")))


def _pagerduty(action: str, key: str) -> Stream:
    return _report(f"pagerduty_{action}", key, F.concat_ws(" ", field_str("host"), field_str("service")))


def pagerduty_resolve(key: str) -> Stream:
    return _pagerduty("resolve", key)


def pagerduty_acknowledge(key: str) -> Stream:
    return _pagerduty("acknowledge", key)


def pagerduty_trigger(key: str) -> Stream:
    return _pagerduty("trigger", key)


# --- transports -------------------------------------------------------------


class Connections:
    """Connections of this process, one for each endpoint, kept between batches and made anew when they break.

    What can't be sent after ``tries`` waits for the next batch, up to ``queue`` payloads an endpoint; beyond that
    the oldest are dropped, and counted.
    """

    def __init__(self, tries: int = 3, wait: float = 0.2, queue: int = 10_000, timeout: float = 10):
        self.tries, self.wait, self.queue, self.timeout = tries, wait, queue, timeout
        self.open: dict[str, socket.socket] = {}
        self.waiting: dict[str, deque] = {}
        self.dropped = 0
        self.lock = threading.Lock()

    def send(self, endpoint: str, payloads: list[bytes]) -> int:
        """How many payloads wait after this."""
        with self.lock:
            queue = self.waiting.setdefault(endpoint, deque())
            for p in payloads:
                if len(queue) >= self.queue:
                    queue.popleft()
                    self.dropped += 1
                queue.append(p)
            for attempt in range(self.tries):
                if attempt:
                    time.sleep(self.wait * 2**attempt)
                try:
                    s = self.open.get(endpoint)
                    if s is None:
                        host, port = endpoint.rsplit(":", 1)
                        s = self.open[endpoint] = socket.create_connection((host, int(port)), timeout=self.timeout)
                    elif self.closed(s):
                        raise OSError("closed by the peer")
                    while queue:
                        s.sendall(queue[0])
                        queue.popleft()
                    return 0
                except OSError:
                    if endpoint in self.open:
                        self.open.pop(endpoint).close()
            return len(queue)

    @staticmethod
    def closed(s: socket.socket) -> bool:
        """Take what the peer has sent (acknowledgements, say), and see whether it has hung up."""
        s.setblocking(False)
        try:
            while part := s.recv(65536):
                pass
            return part == b""
        except BlockingIOError:
            return False
        finally:
            s.settimeout(10)

    def close(self) -> None:
        with self.lock:
            while self.open:
                self.open.popitem()[1].close()


_CONNECTIONS: list[Connections] = []
#: Requests that a process has under way at once, by HTTP and to mail servers.
WORKERS = 8


def connections() -> Connections:
    """This process's own; executors keep their Python workers between tasks."""
    if not _CONNECTIONS:
        _CONNECTIONS.append(Connections())
    return _CONNECTIONS[0]


def send_to_ends(rows: list[dict], payload: Callable[[dict], bytes]) -> None:
    by_end: dict[str, list[bytes]] = {}
    for r in rows:
        by_end.setdefault(r["extra"], []).append(payload(r))
    for end, payloads in by_end.items():
        if left := connections().send(end, payloads):
            log.warning("%d messages to %s wait", left, end)


def send_lines(rows: list[dict]) -> None:
    """Graphite lines, over the endpoint's connection."""
    send_to_ends(rows, lambda r: (r["message"] + "\n").encode())


def send_events(rows: list[dict]) -> None:
    """Length-framed messages to a peer."""
    from tidemark.sources.wire import frame

    send_to_ends(rows, lambda r: frame({"events": [json.loads(r["event"])]}))


def at_once(fn: Callable, rows: list) -> None:
    """Call for all, several at a time; the first failure is raised after all have been tried."""
    with ThreadPoolExecutor(WORKERS) as pool:
        errors = [e for e in (f.exception() for f in [pool.submit(fn, r) for r in rows]) if e]
    if errors:
        raise errors[0]


def send_mail(rows: list[dict]) -> None:
    """Mails, one session for each server."""
    by_server: dict[str, list[dict]] = {}
    for r in rows:
        by_server.setdefault(json.loads(r["extra"])["server"], []).append(r)

    def session(part: tuple[str, list[dict]]) -> None:
        host, _, port = part[0].partition(":")
        with smtplib.SMTP(host, int(port or 0), timeout=10) as server:
            for r in part[1]:
                how = json.loads(r["extra"])
                mail = EmailMessage()
                mail["Subject"], mail["From"], mail["To"] = r["message"], how["from"], ", ".join(how["to"])
                mail.set_content(r["event"])
                server.send_message(mail)

    at_once(session, list(by_server.items()))


def send_incidents(rows: list[dict], url: str = "https://events.pagerduty.com/generic/2010-04-15/create_event.json") -> None:
    """Incidents, several requests at a time; those of one incident in order."""
    by_incident: dict[tuple, list[dict]] = {}
    for r in rows:
        by_incident.setdefault((r["extra"], r["message"]), []).append(r)

    def post(own: list[dict]) -> None:
        for r in own:
            action = r["method"].removeprefix("pagerduty_")
            body = {"service_key": r["extra"], "event_type": action, "incident_key": r["message"], "description": r["message"], "details": json.loads(r["event"])}
            urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=10).close()

    at_once(post, list(by_incident.values()))


def print_rows(rows: list[dict]) -> None:
    for r in rows:
        print(r["message"])


TRANSPORTS: dict[str, Callable[[list[dict]], None]] = {"graphite": send_lines, "forward": send_events, "email": send_mail, "pagerduty_resolve": send_incidents, "pagerduty_acknowledge": send_incidents, "pagerduty_trigger": send_incidents, "print": print_rows}


def deliver(reports: DataFrame, transports: dict[str, Callable[[list[dict]], None]] | None = None, batch: int = 500, keep: bool = False) -> None:
    """Send reports from the executors, each partition's in order, in batches per method. ``keep``: connections stay open for the next delivery."""
    sends = transports or TRANSPORTS

    def run(rows):
        held: dict[str, list[dict]] = {}
        for row in rows:
            held.setdefault(row["method"], []).append(row.asDict())
            if len(held[row["method"]]) >= batch:
                sends[row["method"]](held.pop(row["method"]))
        for method, rest in held.items():
            sends[method](rest)
        if not keep:
            connections().close()

    reports.foreachPartition(run)


def each_batch(program: Stream | Callable[[], Stream], send: Callable[[DataFrame], None] = partial(deliver, keep=True)):
    """A ``foreachBatch`` function: run a stateless program on each micro-batch and deliver its reports.

    ``program`` may be a function that gives the current program, as ``tester.RulesFile`` does. A node with state
    would start afresh with each batch: put it in front, in the streaming plan.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        now = program if isinstance(program, Stream) else program()
        if not now.stateless:
            raise ValueError("a program with state can't run batch by batch: apply its stateful part to the stream")
        reports = now.run(batch).reports
        if reports is not None:
            send(reports)

    return write


def printer(prefix: str = ""):
    """A ``foreachBatch`` function that prints events as JSON."""

    def write(batch: DataFrame, epoch: int) -> None:
        for row in batch.select(json_str().alias("j")).toLocalIterator():
            print(f"{prefix}{row['j']}")

    return write
