"""Stateful operators as small state machines over one key's events in arrival order.

``start`` makes a key's state; ``push`` takes an event (a dict) and returns the events that it
lets out. Batch and streaming runs share these classes where no window function
can express the semantics, and streams use them for all others.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

from tidemark.schema import PREDICATE_DEFAULT_TTL

Python = Callable[[list[float]], float]


def m(e: dict) -> float:
    return 0.0 if e["metric"] is None else e["metric"]


def folded(events: list[dict], fold: Python, seq: int) -> dict:
    times = [e["time"] for e in events if e["time"] is not None]
    return events[0] | {"metric": float(fold([m(e) for e in events])), "time": max(times) if times else None, "seq": seq}


class Machine:
    def start(self):
        return {}

    def push(self, s, e: dict) -> list[dict]:
        raise NotImplementedError


class User(Machine):
    """A state machine given as functions; keys that the functions leave out of an event are kept from the one pushed."""

    def __init__(self, push: Callable[[dict, dict], list[dict]], start: Callable[[], dict]):
        self.own, self.begin = push, start

    def start(self):
        return self.begin()

    def push(self, s, e):
        return [e | x for x in self.own(s, dict(e))]


class ChangedState(Machine):
    def __init__(self, initial: str):
        self.initial = initial

    def push(self, s, e):
        before, s["last"] = s.get("last", self.initial), e["state"] or ""
        return [e] if s["last"] != before else []


class Counter(Machine):
    def push(self, s, e):
        if e["metric"] is None:
            return [e]
        s["n"] = s.get("n", 0) + 1
        return [e | {"metric": float(s["n"])}]


class Ddt(Machine):
    def push(self, s, e):
        before, now = s.get("last"), (m(e), e["time"] or 0)
        s["last"] = now
        if before is None or before[1] == now[1]:
            return []
        return [e | {"metric": (now[0] - before[0]) / (now[1] - before[1])}]


class Throttle(Machine):
    def __init__(self, n: int, dt: float):
        self.n, self.dt = n, dt

    def push(self, s, e):
        t = e["time"] or 0
        if "end" not in s or s["end"] < t:
            s["end"], s["sent"] = t + self.dt, 0
        s["sent"] += 1
        return [e] if s["sent"] <= self.n else []


class Stable(Machine):
    def __init__(self, dt: float):
        self.dt = dt

    def start(self):
        return {"state": "", "start": 0, "held": [], "open": False}

    def push(self, s, e):
        t, state = e["time"] or 0, e["state"] or ""
        if state != s["state"]:
            s.update(state=state, start=t, held=[], open=False)
        elif t < s["start"]:
            return []
        if s["open"]:
            return [e]
        if s["start"] + self.dt > t:
            s["held"].append(e)
            return []
        out, s["held"], s["open"] = [*s["held"], e], [], True
        return out


class Hysteresis(Machine):
    """State critical from ``trigger`` on, until ``cancel``; both through ``stable``, whose output decides what holds now.

    Events carry the two predicates as ``__trigger`` and ``__cancel``.
    """

    def __init__(self, dt: float):
        self.stable = Stable(dt)

    def start(self):
        return {"stable": self.stable.start(), "bad": False}

    def push(self, s, e):
        bad = e["__trigger"] or (s["bad"] and not e["__cancel"])
        out = self.stable.push(s["stable"], e | {"state": "critical" if bad else "ok"})
        if out:
            s["bad"] = out[-1]["state"] != "ok"
        return out


class MovingEvents(Machine):
    def __init__(self, n: int, fold: Python):
        self.n, self.fold = n, fold

    def push(self, s, e):
        s["last"] = [*s.get("last", []), e][-self.n :]
        return [folded(s["last"], self.fold, e["seq"])]


class FixedEvents(Machine):
    def __init__(self, n: int, fold: Python):
        self.n, self.fold = n, fold

    def push(self, s, e):
        held = s.setdefault("held", [])
        held.append(e)
        if len(held) < self.n:
            return []
        s["held"] = []
        return [folded(held, self.fold, e["seq"])]


class MovingTime(Machine):
    def __init__(self, dt: int, fold: Python):
        self.dt, self.fold = dt, fold

    def push(self, s, e):
        if e["time"] is None:
            return []
        top = s["top"] = max(s.get("top", e["time"]), e["time"])
        s["held"] = [x for x in [*s.get("held", []), e] if x["time"] > top - self.dt]
        return [folded(s["held"], self.fold, e["seq"])] if s["held"] else []


class Percentiles(Machine):
    def __init__(self, interval: int, ps: tuple[float, ...]):
        self.interval, self.ps = interval, ps

    def push(self, s, e):
        base, t = s.setdefault("base", e), e["time"] or 0
        at = t - t % self.interval
        out = []
        for start in sorted(k for k in s.get("held", {}) if k + self.interval <= t):
            ms = sorted(s["held"].pop(start))
            out += [base | {"seq": start, "metric": ms[len(ms) - 1 if p == 1 else int(len(ms) * p)], "service": f"{base['service'] or ''} {p:.6f}"} for p in self.ps]
        if e["metric"] is not None:
            s.setdefault("held", {}).setdefault(at, []).append(e["metric"])
        return out


def alive(e: dict, now: float) -> bool:
    if e["state"] == "expired":
        return False
    t = e["time"] or 0
    return now < t or now - t <= (PREDICATE_DEFAULT_TTL if e["ttl"] is None else e["ttl"])


class Coalesce(Machine):
    """The latest event of each (host, service): what has expired is folded and goes, then the rest is folded.

    Expiry is found by a heap of deadlines; sums, counts and means of the live set are kept up,
    other folds are made anew. ``keep_events`` gives the fold whole events.
    """

    def __init__(self, name: str, fold, clock: float | None = None, keep_events: bool = False):
        self.name, self.fold, self.clock, self.keep_events = name, fold, clock, keep_events

    def start(self):
        return {"live": {}, "order": [], "due": [], "now": 0, "sum": 0.0}

    def made(self, events: list[dict], seq: int, total: float | None = None) -> dict:
        if self.keep_events:
            return self.fold(events) | {"seq": seq}
        if total is not None:
            times = [e["time"] for e in events if e["time"] is not None]
            value = {"sum": total, "count": float(len(events)), "mean": total / len(events)}[self.name]
            return events[0] | {"metric": value, "time": max(times) if times else None, "seq": seq}
        return folded(events, self.fold, seq)

    def push(self, s, e):
        key = (e["host"] or "", e["service"] or "")
        now = s["now"] = self.clock if self.clock is not None else max(s["now"], e["time"] or 0)
        if key in s["live"]:
            s["sum"] -= m(s["live"][key])
        else:
            bisect.insort(s["order"], key)
        s["live"][key] = e
        s["sum"] += m(e)
        due = -1 if e["state"] == "expired" else (e["time"] or 0) + (PREDICATE_DEFAULT_TTL if e["ttl"] is None else e["ttl"])
        heapq.heappush(s["due"], (due, key, e["seq"]))
        gone = []
        while s["due"] and s["due"][0][0] < now:
            _, k, seq = heapq.heappop(s["due"])
            old = s["live"].get(k)
            if old is not None and old["seq"] == seq:
                gone.append(s["live"].pop(k))
                s["sum"] -= m(gone[-1])
                s["order"].pop(bisect.bisect_left(s["order"], k))
        out = []
        if gone:
            gone.sort(key=lambda x: (x["host"] or "", x["service"] or ""))
            out.append(self.made(gone, e["seq"]) | {"__expired": True})
        if s["live"]:
            fast = s["sum"] if self.name in ("sum", "count", "mean") and not self.keep_events else None
            if fast is not None:  # only the first event and the greatest time are needed besides
                head, times = s["live"][s["order"][0]], [x["time"] for x in s["live"].values() if x["time"] is not None] if now != e["time"] or key not in s["live"] else [now]
                value = {"sum": fast, "count": float(len(s["live"])), "mean": fast / len(s["live"])}[self.name]
                out.append(head | {"metric": value, "time": max(times) if times else None, "seq": e["seq"]})
            else:
                out.append(self.made([s["live"][k] for k in s["order"]], e["seq"]))
        return out


class Project(Machine):
    """The latest event of each predicate (``__p``: the first that holds, or -1)."""

    def __init__(self, n: int, fold, clock: float | None = None, keep_events: bool = False):
        self.n, self.fold, self.clock, self.keep_events = n, fold, clock, keep_events

    def push(self, s, e):
        now = s["now"] = self.clock if self.clock is not None else max(s.get("now", 0), e["time"] or 0)
        if e["__p"] < 0:
            return []
        slots = s.setdefault("slots", [None] * self.n)
        slots[e["__p"]] = e
        gone = []
        for i, x in enumerate(slots):
            if x is not None and i != e["__p"] and not alive(x, now):
                gone.append(x)
                slots[i] = None
        make = (lambda xs: self.fold(xs) | {"seq": e["seq"]}) if self.keep_events else (lambda xs: folded(xs, self.fold, e["seq"]))
        live = [x for x in slots if x is not None]
        return [make(xs) for xs in (gone, live) if xs]
