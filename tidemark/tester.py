"""The offline rule tester: events in, reports and index out, on a virtual clock.

``python -m tidemark.tester rules.py events.json`` prints what ``rules()`` of the module would do.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.exprs import report_json
from tidemark.plans import index
from tidemark.plans.stream import Context, Stream
from tidemark.sources.files import json_text


def run(events: DataFrame, rules: Stream, ctx: Context | None = None) -> dict:
    """``{"index": [{"time", "event"}], "reports": [[method, {"time", "message", "extra", "event"}]]}``, in order of time and arrival."""
    result = rules.run(events, ctx)
    reports, indexed = [], []
    if result.reports is not None:
        for r in result.reports.filter("method <> 'print'").orderBy("seq", "method").collect():
            reports.append([r["method"], {"time": r["time"], "message": r["message"], "extra": r["extra"], "event": json.loads(r["event"])}])
    if result.indexed is not None:
        for r in result.indexed.orderBy("seq").select("time", report_json().alias("event")).collect():
            indexed.append({"time": r["time"], "event": json.loads(r["event"])})
    return {"index": indexed, "reports": reports}


def index_after(events: DataFrame, rules: Stream, now: float) -> tuple[DataFrame, DataFrame]:
    """The index that a program leaves, split at ``now`` into live and expired."""
    indexed = rules.run(events).indexed
    return index.expire(index.snapshot(indexed), now)


def load_rules(path: str) -> Stream:
    """The program that ``rules()`` of a Python file returns."""
    spec = importlib.util.spec_from_file_location("tidemark_rules", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.rules()


class RulesFile:
    """The program of a rules file, loaded anew when the file has changed; a change that fails to load leaves the last program in force."""

    def __init__(self, path: str):
        self.path, self.stamp, self.program, self.error = path, None, None, None

    def __call__(self) -> Stream:
        stat = os.stat(self.path)
        stamp = (stat.st_mtime_ns, stat.st_size)
        if stamp != self.stamp:
            try:
                self.program, self.error = load_rules(self.path), None
            except Exception as e:
                if self.program is None:
                    raise
                self.error = e
            self.stamp = stamp
        return self.program


class VirtualClock:
    """A clock that only goes forward and runs due tasks in order on its way."""

    def __init__(self):
        self.now, self.tasks, self.number = 0, [], 0

    def once(self, fn, seconds: float, namespace: str = "") -> None:
        self._add(fn, seconds, None, namespace)

    def periodic(self, fn, seconds: float, namespace: str = "") -> None:
        self._add(fn, seconds, seconds, namespace)

    def _add(self, fn, delay, every, namespace):
        self.number += 1
        self.tasks.append((self.now + delay, self.number, fn, every, namespace))

    def remove(self, namespace: str) -> None:
        self.tasks = [t for t in self.tasks if t[4] != namespace]

    def set_time(self, t: float) -> None:
        while due := [x for x in self.tasks if x[0] <= t]:
            first = min(due, key=lambda x: x[:2])
            self.tasks.remove(first)
            self.now = max(self.now, first[0])
            first[2]()
            if first[3]:
                self.tasks.append((first[0] + first[3], first[1], *first[2:]))
        self.now = max(self.now, t)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with open(args[1]) as f:
        print(json.dumps(run(json_text(spark, f.read()), load_rules(args[0])), indent=2))


if __name__ == "__main__":
    main(sys.argv[1:])
