"""The one row type of the engine, and adapters to it.

An event has an arrival number ``seq``; unset fields are NULL. The single ``metric``
is a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("time", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("metric", T.DoubleType()),
        T.StructField("ttl", T.FloatType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)
FIELDS = EVENT.fieldNames()
#: Default time to live of the ``expired`` predicate, and of the index.
PREDICATE_DEFAULT_TTL, INDEX_DEFAULT_TTL = 60, 0


def as_events(df: DataFrame, **columns) -> DataFrame:
    """Select events from any table: a column (or name) for each event field, NULL or empty for the rest."""
    empty = {"tags": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>")}
    pick = []
    for f in EVENT.fields:
        c = columns.get(f.name, empty.get(f.name, F.lit(None)))
        pick.append((F.col(c) if isinstance(c, str) else c).cast(f.dataType).alias(f.name))
    return df.select(*pick)


def events_table(spark: SparkSession, sf_dir: str, ttl: float | None = None) -> DataFrame:
    """The driver's ``events`` table as events."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return as_events(
        raw,
        seq="event_id",
        time=F.unix_seconds(F.col("ts").cast("timestamp")),
        host=F.col("user_id").cast("string"),
        service="event_type",
        metric="value",
        state=F.when(F.col("value") > 80, "critical").otherwise("ok"),
        ttl=F.lit(ttl),
        tags=F.array("event_type"),
        attributes=F.when(k.isNotNull(), F.create_map(F.lit("k"), k)).otherwise(F.create_map().cast("map<string,string>")),
    )


def make_events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Events from dicts, in arrival order."""
    full = [{"tags": [], "attributes": {}} | r | {"seq": r.get("seq", i)} for i, r in enumerate(rows)]
    kinds = {"time": int, "metric": float, "ttl": float}
    values = [tuple(kinds[n](r[n]) if n in kinds and r.get(n) is not None else r.get(n) for n in FIELDS) for r in full]
    return spark.createDataFrame(values, EVENT)
