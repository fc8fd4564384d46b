"""Internal metrics of streaming queries, as events."""

from __future__ import annotations

import json
import random
import threading
import time as clock
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.schema import make_events

TAG = "tidemark::internal"
LATENCIES = (0.0, 0.5, 0.95, 0.99, 1.0)


def progress_events(progress: dict, time: int) -> list[dict]:
    """Rates and latencies of one progress report: state ok, ttl 60, tagged as internal."""
    base = {"time": time, "host": progress.get("name") or progress.get("id"), "state": "ok", "ttl": 60.0, "tags": [TAG]}
    out = [base | {"service": "stream rate", "metric": float(progress.get("processedRowsPerSecond") or 0), "description": "events processed per second"}]
    out.append(base | {"service": "in rate", "metric": float(progress.get("inputRowsPerSecond") or 0), "description": "events received per second"})
    for phase, ms in (progress.get("durationMs") or {}).items():
        out.append(base | {"service": f"latency {phase}", "metric": float(ms), "description": "milliseconds in the last micro-batch"})
    out += [base | {"service": f"state rows {i}", "metric": float(s.get("numRowsTotal", 0)), "description": "rows in a state store"} for i, s in enumerate(progress.get("stateOperators") or [])]
    return out


class InternalMetrics(StreamingQueryListener):
    """Collects progress reports; ``events`` gives the last ``keep`` ones as events."""

    def __init__(self, keep: int = 1000):
        self.keep, self.rows = keep, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        from datetime import datetime

        at = int(datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00")).timestamp())
        self.rows = [*self.rows, *progress_events(json.loads(event.progress.json), at)][-self.keep :]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def events(self, spark: SparkSession) -> DataFrame:
        return make_events(spark, self.rows)


def rate_snapshot(events: DataFrame, seconds: float) -> DataFrame:
    """Events per second of a table that covers so many seconds."""
    return events.agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("metric"))


def latency_snapshot(events: DataFrame, column: str) -> DataFrame:
    """The percentiles of a latency column: p, metric."""
    got = events.agg(F.percentile_approx(column, list(LATENCIES), 10_000).alias("q"))
    return got.select(F.posexplode("q").alias("i", "metric")).select(F.element_at(F.array(*map(F.lit, LATENCIES)), F.col("i") + 1).alias("p"), "metric")


def memory_event(time: int) -> dict:
    """Resident memory of this process in MB."""
    return {"time": time, "service": "memory rss", "metric": memory()[1], "state": "ok", "ttl": 60.0, "tags": [TAG]}


def memory() -> tuple[float, float]:
    """Virtual and resident memory of this process in MB."""
    try:
        with open("/proc/self/statm") as f:
            import resource

            pages = [int(x) * resource.getpagesize() / 1048576 for x in f.read().split()[:2]]
            return pages[0], pages[1]
    except OSError:
        import resource

        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        return peak, peak


class Reservoir:
    """A uniform sample of bounded size of what was added since the last ``take`` (a report of latencies, not data)."""

    def __init__(self, size: int = 1000, seed: int | None = None):
        self.size, self.random = size, random.Random(seed)
        self.values: list[float] = []
        self.count = 0

    def add(self, value: float) -> None:
        self.count += 1
        if len(self.values) < self.size:
            self.values.append(value)
        elif (at := self.random.randrange(self.count)) < self.size:
            self.values[at] = value

    def take(self, ps: tuple[float, ...] = LATENCIES) -> list[tuple[float, float]]:
        """(p, nearest-rank percentile) of the sample, which starts anew; nothing if it is empty."""
        ordered, self.values, self.count = sorted(self.values), [], 0
        return [(p, ordered[min(len(ordered) - 1, int(p * len(ordered)))]) for p in ps] if ordered else []


class Instruments:
    """Rates, latencies and gauges of this process; ``snapshot`` gives all as events, with its memory."""

    def __init__(self, now: Callable[[], float] = clock.time):
        self.now, self.lock = now, threading.Lock()
        self.rates: dict[str, int] = {}
        self.gauges: dict[str, float] = {}
        self.latencies: dict[str, Reservoir] = {}
        self.about: dict[str, str] = {}
        self.since = now()

    def add_rate(self, service: str, description: str = "") -> Callable[[int], None]:
        """A function that counts events."""
        self.rates[service], self.about[service] = 0, description

        def count(n: int = 1) -> None:
            with self.lock:
                self.rates[service] += n

        return count

    def add_latency(self, service: str, description: str = "") -> Callable[[float], None]:
        """A function that takes one latency."""
        self.latencies[service], self.about[service] = Reservoir(), description

        def record(value: float) -> None:
            with self.lock:
                self.latencies[service].add(value)

        return record

    def add_gauge(self, service: str, description: str = "") -> Gauge:
        self.gauges[service], self.about[service] = 0.0, description
        return Gauge(self, service)

    def snapshot(self) -> list[dict]:
        with self.lock:
            at = self.now()
            seconds, self.since = max(1e-9, at - self.since), at
            found = [(s, n / seconds) for s, n in self.rates.items()] + [*self.gauges.items()]
            found += [(f"{s} {p:.6f}", v) for s, r in self.latencies.items() for p, v in r.take()]
            self.rates = dict.fromkeys(self.rates, 0)
        found += list(zip(("memory vm", "memory rss"), memory()))
        about = lambda s: next((d for n, d in self.about.items() if s == n or s.startswith(f"{n} ")), None)
        return [{"time": int(at), "service": s, "metric": float(v), "description": about(s), "state": "ok", "ttl": 60.0, "tags": [TAG]} for s, v in found]


class Gauge:
    def __init__(self, owner: Instruments, service: str):
        self.owner, self.service = owner, service

    def set(self, value: float) -> None:
        with self.owner.lock:
            self.owner.gauges[self.service] = float(value)

    def incr(self, by: float = 1) -> None:
        with self.owner.lock:
            self.owner.gauges[self.service] += by

    def decr(self, by: float = 1) -> None:
        self.incr(-by)


def emit(spark: SparkSession, snapshot: Callable[[], list[dict]], path: str) -> Callable[[], None]:
    """A task for a timer: write a snapshot's events as a Parquet file that ``sources.parquet_stream`` of that folder picks up as events."""

    def write() -> None:
        rows = snapshot()
        if rows:
            base = clock.time_ns() // 1000
            make_events(spark, [r | {"seq": base + i} for i, r in enumerate(rows)]).coalesce(1).write.mode("append").parquet(path)

    return write
