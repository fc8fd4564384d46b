"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger has a row for each
(blob, rule, version) that has been scanned, with the spans found, none
included. A scan takes only blobs that the ledger lacks under some current rule
version, once per blob however many paths hold it, and joins findings back
to all paths.

Positions come from one identity: ``split`` returns what lies between the
matches that ``regexp_extract_all`` returns, so lengths add up to the starts.

Results for odd input: null text counts as empty. Rows whose id is null are
scanned like others. Repeated rows, and copies under other ids, get the same
findings. An empty table gives no rows; extra columns are ignored by ``scan``.
Texts are scanned whole, however long; the walk over a text's matches takes them
by the CHUNK, so that its cost stays near their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tables


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds matches; one counts if its ``group`` has ``least`` code points. A new version is scanned anew."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: The base kinds in their order. A run of hex digits, or of an access
#: key's characters, that is too short holds no long enough one, so their least
#: lengths stand in the patterns.
BASE_RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that this method adds.
MORE_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,end:bigint>>"
#: Matches whose places are summed up together.
CHUNK = 256


def spans(text: Column, rule: SecretRule) -> Column:
    """Start and end (code points, end exclusive) of the rule's matches, left to right."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    length = lambda x: F.char_length(x).cast("long")
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + length(x["b"])
        end = begin + length(x["m"])
        counts = length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(counts, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    # places within each chunk first, then those of chunks: no array is copied once per match
    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
    parts = F.transform(numbers, lambda k: F.aggregate(F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)), start, step))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    moved = lambda acc, c: F.transform(c["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
    walked = F.aggregate(parts, first, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved(acc, c))).alias("out")), lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per row of ``versions``: path, blob, findings (map kind -> spans); ledger rows that are new).

    ``ledger`` has blob, kind, version, spans, as earlier scans returned them.
    """
    v = versions.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    v = v.withColumn("blob", F.sha2("text", 256))
    paths = cut(v.select("path", "blob"))
    # Copies collapse here, before any text moves; a null path is told from others by its own flag.
    blobs = paths.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), F.coalesce("path", F.lit(0).cast(paths.schema["path"].dataType)).alias("path"))).alias("one"))
    if ledger is not None:
        current = " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules)
        known = ledger.filter(current).groupBy("blob").agg(F.collect_set("kind").alias("known"))
        blobs = blobs.join(known, "blob", "left").filter(F.coalesce(F.size("known"), F.lit(0)) < len(rules))
    else:
        blobs = blobs.withColumn("known", F.lit(None).cast("array<string>"))
    todo = blobs.select(F.col("blob").alias("b"), F.col("one.none").alias("none"), F.col("one.path").alias("p"), "known")
    texts = v.withColumn("none", F.col("path").isNull()).withColumn("p", F.coalesce("path", F.lit(0).cast(paths.schema["path"].dataType)))
    texts = texts.join(todo, (texts["none"] == todo["none"]) & (texts["p"] == todo["p"]) & (texts["blob"] == todo["b"])).select("blob", "text", "known")
    unseen = lambda r: ~F.coalesce(F.array_contains("known", r.kind), F.lit(False))
    results = [F.when(unseen(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    fresh = cut(texts.select("blob", F.explode(F.array(*results)).alias("r")).filter("r is not null").select("blob", "r.*").dropDuplicates(["blob", "kind", "version"]))
    every = fresh if ledger is None else fresh.unionByName(ledger.filter(current).select(fresh.columns))
    found = every.filter(F.size("spans") > 0).groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("findings"))
    out = paths.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", F.create_map().cast(f"map<string,{SPANS}>")).alias("findings"))
    return out, fresh


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans of these kinds by start, then kind as listed, comma-joined."""

    def ranked(rank: int, kind: str) -> Column:
        own = F.coalesce(F.try_element_at("findings", F.lit(kind)), F.array().cast(SPANS))
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    ordered = F.sort_array(F.concat(*(ranked(i, k) for i, k in enumerate(kinds))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(tables(spark, sf_dir, "documents"))
    number = lambda k: F.coalesce(F.size(F.try_element_at("findings", F.lit(k))), F.lit(0)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined([r.kind for r in BASE_RULES]), 256).alias("base_sha256"),
        joined([r.kind for r in RULES]).alias("spans"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one = "select doc_id, {rank} as k, '{kind}' as kind, {least} as least, string_split_regex(t, {p}) as b, regexp_extract_all(t, {p}, 0) as m, regexp_extract_all(t, {p}, {group}) as g from d"
    parts = " union all ".join(one.format(rank=i, kind=r.kind, least=r.least, group=r.group, p=quote(r.pattern)) for i, r in enumerate(RULES))
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
f as ({parts}),
i as (select *, unnest(generate_series(1, len(m))) as j from f where len(m) > 0),
s as (select doc_id, k, kind, length(g[j]) >= least as ok,
             cast(list_sum([length(x) for x in b[1:j]]) + coalesce(list_sum([length(x) for x in m[1:j-1]]), 0) as bigint) as a, length(m[j]) as n from i),
o as (select doc_id, k, kind, a, kind || ':' || a || ':' || (a + n) as s from s where ok),
r as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
             string_agg(s, ',' order by a, k) filter (where k < 3) as base, string_agg(s, ',' order by a, k) as spans from o group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join r using (doc_id)"""


SQL = _sql()
