"""Events from JSON and Parquet files, in batch and as streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import EVENT, as_events

KNOWN = ("host", "service", "state", "description", "metric", "time", "ttl", "tags")


def from_json(text: Column, seq: Column) -> dict[str, Column]:
    """Event fields from a JSON object: other keys are attributes, as text."""
    schema = "host string, service string, state string, description string, metric double, time bigint, ttl float, tags array<string>"
    own = F.from_json(text, schema)
    every = F.from_json(text, "map<string,string>")
    out = {c: own[c] for c in KNOWN}
    out["tags"] = F.coalesce(own["tags"], F.array().cast("array<string>"))
    out["attributes"] = F.map_filter(F.coalesce(every, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*KNOWN))
    return out | {"seq": seq}


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON: an array of objects, or one object per line; numbered in the order of their times, equal ones as they stand."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))).alias("value"))
    at = text.withColumn("__at", F.monotonically_increasing_id())
    events = as_events(at, **from_json(F.col("value"), F.col("__at")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("time", F.lit(0)), "seq")
    return events.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def json_text(spark: SparkSession, text: str) -> DataFrame:
    """Events from a JSON array given as text."""
    rows = [(i, json.dumps(x)) for i, x in enumerate(sorted(json.loads(text), key=lambda x: x.get("time") or 0))]
    raw = spark.createDataFrame(rows, "seq long, value string")
    return as_events(raw, **from_json(F.col("value"), F.col("seq")))


def json_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of events from JSON files of one object per line; ``seq`` must be in the data, else time stands in."""
    raw = spark.readStream.options(**options).schema("value string").text(path)
    fields = from_json(F.col("value"), F.lit(None))
    fields["seq"] = F.coalesce(F.get_json_object("value", "$.seq").cast("long"), F.get_json_object("value", "$.time").cast("long"))
    return as_events(raw, **fields)


def parquet_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of events from Parquet files in the event schema."""
    return spark.readStream.options(**options).schema(EVENT).parquet(path)
