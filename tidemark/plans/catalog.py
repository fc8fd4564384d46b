"""Registered queries over the driver's ``events`` table, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import operators as O
from tidemark import metrics, sinks
from tidemark.functions import exprs, folds
from tidemark.functions import predicates as P
from tidemark.plans import index, rules
from tidemark.plans.query import compile_query
from tidemark.plans.stream import Context, Stream, by, create_forwarding_stream, create_stream, create_stateful_stream, sdo, split, where
from tidemark.schema import as_events, events_table
from tidemark.sources import files, wire

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RAW = """raw as (select event_id as seq, cast(floor(epoch(ts)) as bigint) as time, cast(user_id as varchar) as host, event_type as service,
 value as metric, case when value > 80 then 'critical' else 'ok' end as state, json_extract_string(props, '$.k') as k from events)"""


def largest(state: dict, event: dict) -> list[dict]:
    """Events that are larger than all before."""
    before, state["m"] = state.get("m"), max(state.get("m", event["metric"]), event["metric"])
    return [event] if before is None or event["metric"] > before else []


def twice(event: dict, forward: Callable[[dict], None]) -> None:
    if event["service"] == "error":
        forward(event)
        forward(event | {"state": "again"})


def shown(df: DataFrame, columns: str) -> DataFrame:
    """The named columns, metrics to six places."""
    return df.select(*(F.round(c, 6).alias(c) if c == "metric" else F.col(c) for c in columns.split()))


def program(name: str, stream: Callable[[], Stream], columns: str, sql: str | None, ttl: float | None = None, ctx: Context | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(stream().apply(events_table(spark, sf_dir, ttl), ctx), columns)
    if sql:
        SQL[name] = f"with {RAW} {sql}"


def table(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None, ttl: float | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(events_table(spark, sf_dir, ttl))
    if sql:
        SQL[name] = f"with {RAW} {sql}"


# --- filters ------------------------------------------------------------------
NOW = 1_705_000_000
FILTERS = {
    "service": (lambda: O.service("error"), "service = 'error'"),
    "service_any": (lambda: O.service_any(["error", "view"]), "service in ('error', 'view')"),
    "service_like": (lambda: O.service_like("%r%"), "service like '%r%'"),
    "service_like_any": (lambda: O.service_like_any(["e%", "%w"]), "service like 'e%' or service like '%w'"),
    "has_attribute": (lambda: O.has_attribute("k"), "k is not null"),
    "state": (lambda: O.state("critical"), "state = 'critical'"),
    "state_any": (lambda: O.state_any(["critical", "expired"]), "state = 'critical'"),
    "tagged": (lambda: O.tagged("click"), "service = 'click'"),
    "tagged_any": (lambda: O.tagged_any(["click", "view"]), "service in ('click', 'view')"),
    "tagged_all": (lambda: O.tag(["x"]) >> O.tagged_all(["click", "x"]), "service = 'click'"),
    "above": (lambda: O.above(40), "metric > 40"),
    "under": (lambda: O.under(40), "metric < 40"),
    "within": (lambda: O.within(20, 40), "metric between 20 and 40"),
    "without": (lambda: O.without(20, 40), "metric < 20 or metric > 40"),
    "match": (lambda: where(P.match("service", "error") & ~P.match("k", "nil")), "service = 'error' and k is not null"),
    "match_any": (lambda: where(P.match_any("host", ["1", "2", "3"])), "host in ('1', '2', '3')"),
    "match_re": (lambda: where(P.match_re("host", "1[0-9]")), "regexp_full_match(host, '1[0-9]')"),
    "match_re_any": (lambda: where(P.match_re_any("host", ["1.", "2"])), "regexp_full_match(host, '1.|2')"),
    "match_like": (lambda: where(P.match_like("k", "1%")), "k like '1%'"),
    "match_like_any": (lambda: where(P.match_like_any("service", ["%ror", "v%"])), "service like '%ror' or service like 'v%'"),
    "above_eq": (lambda: where(P.above_eq(80)), "metric >= 80"),
    "under_eq": (lambda: where(P.under_eq(80)), "metric <= 80"),
    "default_true": (lambda: where(P.default_true()), "true"),
    "null": (lambda: O.null(), "false"),
    "prn": (lambda: O.prn("> ") >> O.above(60), "metric > 60"),
}
for _n, (_s, _p) in FILTERS.items():
    program(f"filter_{_n}", _s, "seq metric", f"select seq, round(metric, 6) as metric from raw where {_p}")
program("filter_expired", lambda: O.expired(), "seq time", f"select seq, time from raw where {NOW} >= time and {NOW} - time > 86400", 86400, Context(clock=NOW))
program("filter_not_expired", lambda: O.not_expired(), "seq time", f"select seq, time from raw where not ({NOW} >= time and {NOW} - time > 60)", None, Context(clock=NOW))

# --- setters and scalar transforms ----------------------------------------------
for _f, _v in (("service", "s"), ("state", "warn"), ("host", "h"), ("description", "d")):
    program(f"set_{_f}", lambda f=_f, v=_v: getattr(O, f"set_{f}")(v), f"seq {_f}", f"select seq, '{_v}' as {_f} from raw")
    program(f"default_{_f}", lambda f=_f, v=_v: O.smap({f: F.when(F.col("seq") % 2 == 0, F.lit("set"))}) >> getattr(O, f"default_{f}")(v), f"seq {_f}", f"select seq, case when seq % 2 = 0 then 'set' else '{_v}' end as {_f} from raw")
program("set_metric", lambda: O.set_metric(1.5), "seq metric", "select seq, cast(1.5 as double) as metric from raw")
program("default_metric", lambda: O.smap({"metric": F.when(F.col("seq") % 2 == 0, F.col("metric"))}) >> O.default_metric(2), "seq metric", "select seq, case when seq % 2 = 0 then round(metric, 6) else cast(2 as double) end as metric from raw")
table("set_ttl", lambda e: O.set_ttl(5).apply(e).select("seq", F.col("ttl").cast("double").alias("ttl")), "select seq, cast(5 as double) as ttl from raw")
table("default_ttl", lambda e: O.default_ttl(7).apply(e).select("seq", F.col("ttl").cast("double").alias("ttl")), "select seq, cast(7 as double) as ttl from raw")
table("with", lambda e: O.with_({"host": "h", "time": 5, "metric": 2.5, "zone": "a"}).apply(e).select("seq", "host", "time", "metric", F.col("attributes")["zone"].alias("zone")), "select seq, 'h' as host, cast(5 as bigint) as time, cast(2.5 as double) as metric, 'a' as zone from raw")
table("default_to", lambda e: O.default_to({"host": "h", "description": "d", "k": "none", "zone": "a"}).apply(e).select("seq", "host", "description", F.col("attributes")["k"].alias("k"), F.col("attributes")["zone"].alias("zone")), "select seq, host, 'd' as description, coalesce(k, 'none') as k, 'a' as zone from raw")
program("scale", lambda: O.scale(2.5), "seq metric", "select seq, round(2.5 * metric, 6) as metric from raw")
table("tag", lambda e: O.tag(["a", "a"]).apply(e).select("seq", F.array_join("tags", ",").alias("tags")), "select seq, service || ',a,a' as tags from raw")
program("smap", lambda: O.smap({"metric": F.col("metric") + 1, "state": F.upper("state")}), "seq metric state", "select seq, round(metric + 1, 6) as metric, upper(state) as state from raw")
program("counter", lambda: by(["service"], O.counter()), "seq metric", "select seq, cast(count(metric) over (partition by service order by seq) as double) as metric from raw")
table("ddt", lambda e: by(["service"], O.ddt()).apply(e).select("seq", "metric"), ", l as (select *, lag(metric) over w pm, lag(time) over w pt from raw window w as (partition by service order by seq)) select seq, (metric - pm) / (time - pt) as metric from l where pt is not null and pt <> time")

# --- composition ------------------------------------------------------------------
program("compose", lambda: O.service("error") >> O.above(50) >> O.set_state("bad") >> O.scale(2), "seq state metric", "select seq, 'bad' as state, round(2 * metric, 6) as metric from raw where service = 'error' and metric > 50")
program("sdo", lambda: sdo(O.above(90), O.service("view") >> O.scale(2), O.null()), "seq metric", "select seq, round(metric, 6) as metric from raw where metric > 90 union all select seq, round(2 * metric, 6) from raw where service = 'view'")
program("split", lambda: split([(P.above(80), O.set_state("high") >> O.above(100)), (P.service("view"), O.set_state("view"))], O.set_state("rest") >> O.under(20)), "seq state", "select seq, case when metric > 80 then 'high' when service = 'view' then 'view' else 'rest' end as state from raw where case when metric > 80 then metric > 100 when service = 'view' then true else metric < 20 end")
program("split_collapsed", lambda: split([(P.above(80), O.set_state("high")), (P.service("view"), O.set_state("view"))]), "seq state", "select seq, case when metric > 80 then 'high' when service = 'view' then 'view' else state end as state from raw")
program("where_else", lambda: where(P.above(80), O.set_state("low") >> by(["service"], O.counter())), "seq state metric", ", c as (select *, count(*) over (partition by service order by seq) n from raw where not metric > 80) select seq, state, round(metric, 6) as metric from raw where metric > 80 union all select seq, 'low', cast(n as double) from c")
program("by_rest", lambda: by(["host"]) >> O.counter() >> O.above(10), "seq metric", ", c as (select seq, count(*) over (partition by host order by seq) n from raw) select seq, cast(n as double) as metric from c where n > 10")
program("by_nested", lambda: by(["host"], by(["service"], O.counter()) >> O.moving_event_window(2, folds.sum)), "seq metric", ", c as (select seq, host, count(*) over (partition by host, service order by seq) n from raw) select seq, cast(sum(n) over (partition by host order by seq rows between 1 preceding and current row) as double) as metric from c")

# --- folds and windows --------------------------------------------------------------
FOLD_SQL = {"sum": "sum(metric)", "product": "product(metric)", "difference": "2 * arg_min(metric, seq) - sum(metric)", "mean": "avg(metric)", "minimum": "min(metric)", "maximum": "max(metric)", "count": "cast(count(*) as double)"}
for _n, _s in FOLD_SQL.items():
    program(f"fold_{_n}", lambda n=_n: by(["service"], O.fixed_event_window(3, folds.BY_NAME[n])), "seq time service metric", f", g as (select *, (row_number() over (partition by service order by seq) - 1) // 3 as g from raw) select max(seq) as seq, max(time) as time, service, round({_s}, 6) as metric from g group by service, g having count(*) = 3")
program("fold_user", lambda: by(["service"], O.fixed_event_window(3, folds.user("range", lambda ms: max(ms) - min(ms)))), "seq metric", ", g as (select *, (row_number() over (partition by service order by seq) - 1) // 3 as g from raw) select max(seq) as seq, round(max(metric) - min(metric), 6) as metric from g group by service, g having count(*) = 3")
program("moving_event_window", lambda: by(["service"], O.moving_event_window(5, folds.mean)), "seq time host metric", "select seq, max(time) over w as time, first_value(host) over w as host, round(avg(metric) over w, 6) as metric from raw window w as (partition by service order by seq rows between 4 preceding and current row)")
program("fixed_event_window", lambda: by(["host"], O.fixed_event_window(7, folds.maximum)), "seq time service metric", ", g as (select *, (row_number() over (partition by host order by seq) - 1) // 7 as g from raw) select max(seq) as seq, max(time) as time, arg_min(service, seq) as service, round(max(metric), 6) as metric from g group by host, g having count(*) = 7")
MOVING = "sum(metric) over (partition by service order by time range between 3599 preceding and current row) - coalesce(sum(metric) over (partition by service, time order by seq rows between 1 following and unbounded following), 0)"
QUERIES["moving_time_window"] = lambda spark, sf_dir: by(["service"], O.moving_time_window(3600, folds.sum)).apply(events_table(spark, sf_dir)).select("seq", F.round("metric", 4).alias("metric"))
SQL["moving_time_window"] = f"with {RAW} select seq, round({MOVING}, 4) as metric from raw"
program("moving_time_window_max", lambda: by(["service"], O.moving_time_window(3600, folds.maximum)), "seq metric", "select a.seq, round(max(b.metric), 6) as metric from raw a join raw b on a.service = b.service and b.seq <= a.seq and b.time > a.time - 3600 group by a.seq")
program("fixed_time_window", lambda: by(["service"], O.fixed_time_window(3600, folds.sum)), "time service metric", ", m as (select service, max(time) top from raw group by service) select max(time) as time, service, round(sum(metric), 6) as metric from raw join m using (service) where time - time % 3600 + 3600 <= top group by service, time - time % 3600")
program("rate", lambda: O.rate(600), "time metric", ", w as (select time - time % 600 s, sum(metric) m from raw group by 1), b as (select min(s) a, max(s) z from w), g as (select unnest(generate_series(a, z - 600, 600)) s from b) select s + 600 as time, round(coalesce(m, 0) / 600, 6) as metric from g left join w using (s)")
program("rate_by", lambda: by(["service"], O.rate(3600)), "time metric", ", w as (select service, time - time % 3600 s, sum(metric) m from raw group by 1, 2), z as (select max(s) z from w), b as (select service, min(s) a from w group by 1), g as (select service, unnest(generate_series(a, z - 3600, 3600)) s from b, z) select s + 3600 as time, round(coalesce(m, 0) / 3600, 6) as metric from g left join w using (service, s)")
program("percentiles", lambda: by(["service"], O.percentiles(86400, [0, 0.5, 0.95, 1])), "seq service metric", ", w as (select service, time - time % 86400 s, list_sort(list(metric)) ms from raw group by 1, 2), t as (select max(time) top from raw), p(p, n) as (values (0.0, '0.000000'), (0.5, '0.500000'), (0.95, '0.950000'), (1.0, '1.000000')) select s as seq, service || ' ' || n as service, round(ms[1 + case when p = 1 then len(ms) - 1 else cast(floor(len(ms) * cast(p as double)) as bigint) end], 6) as metric from w, t, p where s + 86400 <= top")

# --- live sets and state changes ------------------------------------------------------
LIVE = """, a as (select seq, time t, host, service, {m} m, lead(seq) over (partition by host, service order by seq) nseq, time + {ttl} due, {key} key from raw),
b as (select {key} key, time bt, min(seq) xseq from raw group by all),
x as (select a.*, b.xseq from a asof left join b on a.key = b.key and a.due < b.bt),
y as (select *, case when nseq is null or xseq < nseq then xseq end gone from x),
d as (select seq, key, m dm, 1 dn from y union all select coalesce(gone, nseq), key, -m, -1 from y where coalesce(gone, nseq) is not null),
r as (select key, seq, sum(sum(dm)) over w sm, sum(sum(dn)) over w n from d group by key, seq window w as (partition by key order by seq rows unbounded preceding)),
e as (select key, gone as seq, sum(m) sm, count(*) n, max(t) t from y where gone is not null group by key, gone),
u as (select key, seq, 0 as sub, sm, n, t from e union all select r.key, seq, 1, sm, n, time from r join raw using (seq) where n > 0)"""


# both outputs of an event: over what has expired, and over what is alive
for _n, _v, _ttl in (("count", "cast(n as double)", 86400), ("sum", "round(sm, 4)", 3600), ("mean", "round(0.37777771 * sm / n, 6)", 86400)):
    table(f"coalesce_{_n}", lambda e, n=_n: O.coalesce(folds.BY_NAME[n]).apply(e).select("seq", "time", F.round(0.37777771 * F.col("metric"), 6).alias("metric") if n == "mean" else F.round("metric", 4).alias("metric")), LIVE.format(m="metric", ttl=_ttl, key="1") + f" select seq, t as time, {_v} as metric from u", _ttl)
for _n, _v in (("maximum", "max"), ("minimum", "min")):
    table(f"coalesce_{_n}", lambda e, n=_n: by(["service"], O.coalesce(folds.BY_NAME[n])).apply(e).select("seq", "host", F.round("metric", 6).alias("metric")), LIVE.format(m="metric", ttl=86400, key="service") + f" select gone as seq, min(host) as host, round({_v}(m), 6) as metric from y where gone is not null group by key, gone union all select z.seq, min(y.host), round({_v}(y.m), 6) from raw z join y on y.key = z.service and y.seq <= z.seq and coalesce(y.gone, y.nseq, 9000000000) > z.seq group by z.seq", 86400)
PROJECT = """, e as (select *, case when service = 'error' then 0 when service = 'purchase' then 1 end p from raw where service in ('error', 'purchase')),
s as (select seq, time, p, last_value(case when p = 0 then seq end ignore nulls) over w s0, last_value(case when p = 0 then time end ignore nulls) over w t0, last_value(case when p = 0 then metric end ignore nulls) over w m0,
 last_value(case when p = 1 then seq end ignore nulls) over w s1, last_value(case when p = 1 then time end ignore nulls) over w t1, last_value(case when p = 1 then metric end ignore nulls) over w m1 from e window w as (order by seq rows unbounded preceding)),
o as (select *, s0 is not null and p <> 0 and time - t0 > 600 as x0, s1 is not null and p <> 1 and time - t1 > 600 as x1 from s),
n as (select *, x0 and not (coalesce(lag(x0) over (order by seq), false) and lag(s0) over (order by seq) = s0) as g0, x1 and not (coalesce(lag(x1) over (order by seq), false) and lag(s1) over (order by seq) = s1) as g1 from o)
select seq, round(case when g0 then m0 else 0 end + case when g1 then m1 else 0 end, 6) as metric from n where g0 or g1
union all select seq, round(case when s0 is not null and not x0 then m0 else 0 end + case when s1 is not null and not x1 then m1 else 0 end, 6) from n"""
program("project", lambda: O.project([P.service("error"), P.service("purchase")], folds.sum), "seq metric", PROJECT, 600)
program("changed_state", lambda: O.changed_state(), "seq state", ", l as (select *, lag(state, 1, 'ok') over (partition by host, service order by seq) b from raw) select seq, state from l where b <> state")
STABLE = """, a as (select *, case when state <> lag(state, 1, '') over (partition by service order by seq) then 1 else 0 end c from raw),
b as (select *, sum(c) over (partition by service order by seq rows unbounded preceding) r from a)
select seq, state from (select seq, state, time, min(time) over w t0, max(time) over w t1 from b window w as (partition by service, r)) z where t1 >= t0 + {dt}"""
program("stable", lambda: by(["service"], O.stable(900)), "seq state", STABLE.format(dt=900))
THROTTLE = """with recursive {raw}, e as (select seq, service, time t, row_number() over (partition by service order by seq) rn from raw),
r as (select service, rn, seq, t + 3600 pe, 1 f, true ok from e where rn = 1
      union all select e.service, e.rn, e.seq, case when r.pe < e.t then e.t + 3600 else r.pe end,
        case when r.pe < e.t then 1 when r.f < 2 then r.f + 1 else r.f end, (r.pe < e.t or r.f < 2)
      from r join e on e.service = r.service and e.rn = r.rn + 1)
select seq from r where ok"""
program("throttle", lambda: by(["service"], O.throttle(2, 3600)), "seq", None)
SQL["throttle"] = THROTTLE.format(raw=RAW)

# --- rules ------------------------------------------------------------------------------
program("rule_flagship", lambda: O.service("error") >> O.above(80) >> O.set_state("critical") >> O.changed_state(), "seq host metric", ", f as (select *, row_number() over (partition by host order by seq) n from raw where service = 'error' and metric > 80) select seq, host, round(metric, 6) as metric from f where n = 1")
program("rule_critical_above", lambda: rules.critical_above(50), "seq state", "select seq, case when metric > 50 then 'critical' else 'ok' end as state from raw")
program("rule_critical_under", lambda: rules.critical_under(50), "seq state", "select seq, case when metric < 50 then 'critical' else 'ok' end as state from raw")
program("rule_stable_trigger", lambda: by(["service"], rules.stable_metric(900, P.above(80))), "seq state", STABLE.format(dt=900))
HYSTERESIS = """with recursive {raw} {source},
hs as (select *, row_number() over (partition by key order by seq, sub) rn from (select key, seq, sub, t, metric, {trigger} as trig, {cancel} as can from {name}) z),
hr as (select key, rn, seq, metric, case when trig then 'critical' else 'ok' end as st, t as start, {dt} <= 0 as open, {dt} <= 0 and trig as bad, 1 as run, true as inn from hs where rn = 1
 union all
 select key, rn, seq, metric, st, start, open, case when inn and open then st <> 'ok' else bad end, run, inn from (
  select key, rn, seq, metric, st, case when st <> old then t else start end as start, st <> old or t >= start as inn,
   case when st <> old then {dt} <= 0 when t >= start then open or start + {dt} <= t else open end as open, bad, case when st <> old then run + 1 else run end as run
  from (select hs.key, hs.rn, hs.seq, hs.metric, hs.t, r.st as old, r.start, r.open, r.bad, r.run,
               case when hs.trig or (r.bad and not hs.can) then 'critical' else 'ok' end as st
        from hr r join hs on hs.key = r.key and hs.rn = r.rn + 1) z) z)
select {columns} from (select *, bool_or(open) over (partition by key, run) as o from hr) z where o and inn"""
program("rule_stable_metric", lambda: by(["service"], rules.stable_metric(900, P.above(80), P.under(40))), "seq state", None)
SQL["rule_stable_metric"] = HYSTERESIS.format(raw=RAW, source=", i as (select *, service as key, 0 as sub, time as t from raw)", name="i", trigger="metric > 80", cancel="metric < 40", dt=900, columns="seq, st as state")
program("rule_agg_stable_metric", lambda: by(["service"], rules.agg_stable_metric(900, folds.mean, P.above(52), P.under(48))) >> O.scale(0.37777771), "seq state metric", None, 86400)
SQL["rule_agg_stable_metric"] = HYSTERESIS.format(raw=RAW, source=LIVE.format(m="metric", ttl=86400, key="service") + ", i as (select key, seq, sub, t, sm / n as metric from u)", name="i", trigger="metric > 52", cancel="metric < 48", dt=900, columns="seq, st as state, round(0.37777771 * metric, 6) as metric")
table("rule_max_critical_hosts", lambda e: rules.max_critical_hosts(40).apply(e).select("seq", "state"), LIVE.format(m="case when state = 'critical' then 1 else 0 end", ttl=86400, key="1") + " select seq, case when sm >= 40 then 'critical' else 'ok' end as state from u", 86400)
program("rule_ratio", lambda: rules.ratio("error", "view", 1), "seq service metric", ", e as (select * from raw where service in ('error', 'view')), s as (select seq, last_value(case when service = 'error' then time end ignore nulls) over w t0, last_value(case when service = 'error' then metric end ignore nulls) over w m0, last_value(case when service = 'view' then time end ignore nulls) over w t1, last_value(case when service = 'view' then metric end ignore nulls) over w m1 from e window w as (order by seq rows unbounded preceding)) select seq, 'error / view' as service, round(case when m1 = 0 then 1 else m0 / m1 end, 6) as metric from s where t0 is not null and t1 is not null and abs(t0 - t1) < 60")
# two thousand seconds as one, so that a host's events meet
program("rule_per_host_ratio", lambda: O.smap({"time": F.floor(F.col("time") / 2000)}) >> rules.per_host_ratio("error", "view", 1, 20, P.above(0.7), P.under(0.5)), "seq service metric state", None)
SQL["rule_per_host_ratio"] = HYSTERESIS.format(raw=RAW, source=""", i as (select seq, host, service, metric, time // 2000 as time from raw where service in ('error', 'view')),
j as (select seq, host, last_value(case when service = 'error' then time end ignore nulls) over w t0, last_value(case when service = 'error' then metric end ignore nulls) over w m0, last_value(case when service = 'view' then time end ignore nulls) over w t1, last_value(case when service = 'view' then metric end ignore nulls) over w m1 from i window w as (partition by host order by seq rows unbounded preceding)),
k as (select host as key, seq, 0 as sub, greatest(t0, t1) as t, case when m1 = 0 then 1 else m0 / m1 end as metric from j where t0 is not null and t1 is not null and abs(t0 - t1) < 60)""", name="k", trigger="metric > 0.7", cancel="metric < 0.5", dt=20, columns="seq, 'error / view' as service, round(metric, 6) as metric, st as state")
program("rule_stable_event_stream", lambda: by(["service"], rules.stable_event_stream(3)), "seq state", ", s as (select seq, state, min(state) over w a, max(state) over w b, count(*) over w n from raw window w as (partition by service order by seq rows between 2 preceding and current row)) select seq, state from s where a = b and n = 3")
table("rule_targets", lambda e: rules.create_targets("key", "ops").all.run(e).reports.select("seq", "method", "message"), ", l as (select *, lag(state, 1, 'ok') over (partition by host, service order by seq) b from raw), c as (select * from l where b <> state) select seq, 'email' as method, host || ' ' || service || ' ' || state as message from c union all select seq, case when state = 'ok' then 'pagerduty_resolve' else 'pagerduty_trigger' end, host || ' ' || service from c")

# --- query language: one query per production --------------------------------------------
LANGUAGE = {
    "true": ("true", "true"),
    "tagged": ('tagged "click"', "service = 'click'"),
    "tagged_eq": ('tagged = "view"', "service = 'view'"),
    "nil": ("description = nil", "seq % 5 <> 0"),
    "nil_attribute": ("not k = nil", "k is not null"),
    "string_eq": ('service = "error"', "service = 'error'"),
    "string_like": ('service =~ "%r%"', "service like '%r%'"),
    "string_order": ('host > "1" or service = "view"', "service = 'view'"),
    "attribute_eq": ('k = "42"', "k = '42'"),
    "attribute_int": ("k >= 50", "try_cast(k as double) >= 50"),
    "attribute_double": ("k < 49.5", "try_cast(k as double) < 49.5"),
    "time": ("time >= 1705000000", "time >= 1705000000"),
    # time and ttl compare with integers only; with a fraction the name is that of an attribute
    "time_double": ('time > 1705000000.5 or host = "1"', "host = '1'"),
    "ttl_double": ('ttl > 7.5 or host = "2"', "host = '2'"),
    "ttl": ("ttl < 5", "seq % 3 <> 0"),
    "metric_int": ("metric > 80", "metric > 80"),
    "metric_double": ("metric <= 40.5", "metric <= 40.5"),
    "and": ('service = "error" and metric > 50', "service = 'error' and metric > 50"),
    "or": ('service = "error" or service = "view"', "service in ('error', 'view')"),
    "not": ('not service = "error" and metric > 50', "service <> 'error' and metric > 50"),
    "precedence": ('service = "error" or service = "view" and metric > 50', "service in ('error', 'view') and metric > 50"),
    "brackets": ('service = "error" or (service = "view" and metric > 50)', "service = 'error' or (service = 'view' and metric > 50)"),
}
for _n, (_q, _p) in LANGUAGE.items():
    # some events with a time to live and a description, so that these fields tell rows apart
    table(f"query_{_n}", lambda e, q=_q: e.withColumns({"ttl": F.when(F.col("seq") % 3 == 0, 10.0).otherwise(F.lit(2.0)).cast("float"), "description": F.when(F.col("seq") % 5 == 0, "d")}).filter(compile_query(q)).select("seq"), f"select seq from raw where {_p}")

# --- index -------------------------------------------------------------------------------
LATEST = ", i as (select * from (select *, row_number() over (partition by host, service order by seq desc) rn from raw) z where rn = 1)"
table("index_snapshot", lambda e: shown(index.snapshot(e), "seq host service metric"), f"{LATEST} select seq, host, service, round(metric, 6) as metric from i")
table("index_live", lambda e: index.expire(index.snapshot(e), 1_706_500_000)[0].select("seq", "state"), f"{LATEST} select seq, state from i where not time + 3600 < 1706500000", 3600)
table("index_expired", lambda e: index.expire(index.snapshot(e), 1_706_500_000)[1].select("seq", "state"), f"{LATEST} select seq, 'expired' as state from i where time + 3600 < 1706500000", 3600)
table("index_query", lambda e: index.query(index.snapshot(e), 'service = "error" and metric > 50', None).select("seq", "host"), f"{LATEST} select seq, host from i where service = 'error' and metric > 50")
table("index_changes", lambda e: index.subscribe(index.snapshot(e), index.changes(e), 'state = "critical"')[1].select("seq"), "select seq from raw where state = 'critical'")
table("send_index", lambda e: shown(index.snapshot(sinks.send_index().run(e).indexed), "seq metric"), f"{LATEST} select seq, round(metric, 6) as metric from i")

# --- functions, sinks, metrics --------------------------------------------------------------
table("metric_str", lambda e: e.select("seq", exprs.metric_str().alias("s")), "select seq, printf('%.6f', metric) as s from raw")
table("field_str", lambda e: e.select("seq", exprs.field_str("host").alias("host"), exprs.field_str("description").alias("description"), exprs.field_str("k").alias("k"), exprs.field_str("zone").alias("zone")), "select seq, host, '' as description, coalesce(k, 'nil') as k, 'nil' as zone from raw")
table("has_field", lambda e: e.select("seq", exprs.has_field("host").alias("host"), exprs.has_field("ttl").alias("ttl"), exprs.has_field("k").alias("k")), "select seq, true as host, false as ttl, k is not null as k from raw")
table("json_str", lambda e: e.select("seq", F.get_json_object(exprs.json_str(), "$.host").alias("host"), F.get_json_object(exprs.json_str(), "$.k").alias("k"), F.get_json_object(exprs.json_str(), "$.tags[0]").alias("tag"), F.get_json_object(exprs.json_str(), "$.ttl").alias("ttl")), "select seq, host, k, service as tag, cast(null as varchar) as ttl from raw", 5)
table("uri_params", lambda e: e.select("seq", exprs.uri_params(F.concat(F.lit("/index?subscribe=true&query=host%20%3D%20"), "host"))["query"].alias("q")), "select seq, 'host = ' || host as q from raw")
table("sink_graphite", lambda e: sinks.send_graphite("g", 2003).run(e).reports.select("seq", F.split("message", " ")[0].alias("path"), F.round(F.split("message", " ")[1].cast("double"), 6).alias("metric"), F.split("message", " ")[2].alias("at")), "select seq, host || '.' || service as path, round(metric, 6) as metric, cast(time as varchar) as at from raw")
table("sink_forward", lambda e: sinks.forward("peer", 5555).run(e).reports.select("seq", "extra", *(F.get_json_object("message", f"$.{c}").alias(c) for c in ("host", "service", "state", "time"))), "select seq, 'peer:5555' as extra, host, service, state, cast(time as varchar) as time from raw")
table("prn_lines", lambda e: (O.above(60) >> O.prn("> ") >> O.null()).run(e).reports.select("seq", "method", F.substring("message", 1, 2).alias("prefix"), F.get_json_object(F.expr("substring(message, 3)"), "$.host").alias("host")), "select seq, 'print' as method, '> ' as prefix, host from raw where metric > 60")
table("stateful_function", lambda e: by(["service"], create_stateful_stream(largest)).apply(e).select("seq", F.round("metric", 6).alias("metric")), ", m as (select *, max(metric) over (partition by service order by seq rows between unbounded preceding and 1 preceding) b from raw) select seq, round(metric, 6) as metric from m where b is null or metric > b")
table("forwarding_function", lambda e: create_forwarding_stream(twice).apply(e).select("seq", "state"), "select seq, state from raw where service = 'error' union all select seq, 'again' from raw where service = 'error'")
table("sink_email", lambda e: (O.above(90) >> sinks.email("mail", "a@b", ["c@d", "e@f"])).run(e).reports.select("seq", "message", F.get_json_object("extra", "$.to[1]").alias("to")), "select seq, host || ' ' || service || ' ' || state as message, 'e@f' as to from raw where metric > 90")
table("sink_pagerduty_acknowledge", lambda e: (O.above(90) >> sinks.pagerduty_acknowledge("key")).run(e).reports.select("seq", "method", "extra"), "select seq, 'pagerduty_acknowledge' as method, 'key' as extra from raw where metric > 90")
table("sha1_base64", lambda e: e.select("seq", exprs.sha1_base64(F.concat("host", F.lit("/"), "service")).alias("hash")), "select seq, to_base64(from_hex(sha1(host || '/' || service))) as hash from raw")
table("conj", lambda e: e.select("seq", F.array_join(exprs.conj(F.col("tags"), F.col("host")), ",").alias("items")), "select seq, service || ',' || host as items from raw")
table("report_json", lambda e: e.select("seq", *(F.get_json_object(exprs.report_json(), f"$.{c}").alias(c) for c in ("host", "description", "time")), F.get_json_object(exprs.report_json(), "$.tags[0]").alias("tag")), "select seq, host, '' as description, cast(time as varchar) as time, service as tag from raw")
program("create_stream", lambda: create_stream(lambda df: df.filter(F.col("metric") > 50).withColumn("state", F.lit("seen"))) >> O.scale(2), "seq state metric", "select seq, 'seen' as state, round(2 * metric, 6) as metric from raw where metric > 50")
# there and back: messages of the binary format, and JSON
SENT = "select seq {shift} as seq, time, host, service, state, round(metric, 6) as metric, service as tag, k from raw"
sent = lambda e: e.select("seq", "time", "host", "service", "state", F.round("metric", 6).alias("metric"), F.element_at("tags", 1).alias("tag"), F.col("attributes")["k"].alias("k"))
table("wire_messages", lambda e: sent(wire.decode_messages(wire.encode_messages(e))), SENT.format(shift="* 1048576"))
table("json_messages", lambda e: sent(as_events(e.select("seq", exprs.json_str().alias("j")), **files.from_json(F.col("j"), F.col("seq")))), SENT.format(shift=""))
# entries that expire go through the rules again
table("index_expired_again", lambda e: (sdo() >> O.expired() >> O.set_description("gone")).apply(index.changes(e).filter("seq < 0").unionByName(index.expire(index.snapshot(e), 1_706_500_000)[1]), Context(clock=0)).select("seq", "state", "description"), f"{LATEST} select seq, 'expired' as state, 'gone' as description from i where time + 3600 < 1706500000", 3600)
table("rate_snapshot", lambda e: metrics.rate_snapshot(e, 100.0).select(F.round("metric", 6).alias("metric")), "select round(count(*) / 100.0, 6) as metric from raw")
