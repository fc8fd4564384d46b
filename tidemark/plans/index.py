"""The index: the latest event of each host and service, by arrival."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.query import compile_query
from tidemark.schema import EVENT, FIELDS, INDEX_DEFAULT_TTL

#: Rows that a query gives at most, unless told otherwise.
MAX_MATCHES = 200_000


def snapshot(events: DataFrame, add_expired: bool = False) -> DataFrame:
    """Upserts in arrival order: one row per host and service. Events in state expired are not indexed."""
    if not add_expired:
        events = events.filter(F.coalesce("state", F.lit("")) != "expired")
    keys = [F.coalesce("host", F.lit("")), F.coalesce("service", F.lit(""))]
    latest = events.groupBy(keys[0].alias("__h"), keys[1].alias("__s")).agg(F.max_by(F.struct(*FIELDS), "seq").alias("e"))
    return latest.select("e.*")


def is_old(now: float | Column) -> Column:
    return (F.coalesce("time", F.lit(0)) + F.coalesce("ttl", F.lit(float(INDEX_DEFAULT_TTL))).cast("long")) < now


def expire(index: DataFrame, now: float | Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes: in state expired, to be fed to the streams again)."""
    now = now if isinstance(now, Column) else F.lit(now)
    return index.filter(~is_old(now)), index.filter(is_old(now)).withColumn("state", F.lit("expired"))


def query(index: DataFrame, text: str, limit: int | None = MAX_MATCHES) -> DataFrame:
    """The rows that match; with a limit, those that arrived first. None: all."""
    found = index.filter(compile_query(text))
    return found if limit is None else found.orderBy("seq").limit(limit)


def subscribe(index: DataFrame, changes: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(matching snapshot, matching changes): write the first once, then the second as it comes."""
    p = compile_query(text)
    return index.filter(p), changes.filter(p)


def changes(events: DataFrame) -> DataFrame:
    """Everything that is published when events are indexed: the events themselves, in arrival order."""
    return events.filter(F.coalesce("state", F.lit("")) != "expired")


class Topics:
    """Named change feeds; any number of subscribers may read one."""

    def __init__(self):
        self.feeds: dict[str, DataFrame] = {}

    def publish(self, topic: str, feed: DataFrame) -> None:
        self.feeds[topic] = feed

    def subscribe(self, topic: str, text: str = "true") -> DataFrame:
        return self.feeds[topic].filter(compile_query(text))


class LiveIndex:
    """The index of a stream, kept in Parquet in a folder that all executors see.

    Rows are dealt to buckets by host and service. A change rewrites only the buckets it touches, under a
    new version; a manifest names each bucket's version, so readers see all of a change or nothing of it. Versions
    that no manifest of the last two names are deleted. ``expire`` is for a timer: what is too old
    goes, and is written to ``expired``, which ``expired_events`` reads as a stream, to be fed to the rules again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.lock = threading.Lock()

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[int]:
        fs, path = self._fs(f"{self.path}/manifest")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def manifest(self) -> dict:
        known = self._manifests()
        if not known:
            return {"number": 0, "epoch": -1, "buckets": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{known[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _table(self, versions: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def table(self) -> DataFrame:
        return self._table(self.manifest()["buckets"])

    def _replace(self, before: dict, rows: DataFrame, touched: set[str], epoch: int) -> None:
        version = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(F.coalesce("host", F.lit("")), F.coalesce("service", F.lit(""))), F.lit(self.buckets))
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        fs, at = self._fs(f"{self.path}/data/{version}")
        made = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(at) if f.getPath().getName().startswith("bucket=")}
        buckets = {b: v for b, v in before["buckets"].items() if b not in touched} | dict.fromkeys(made, version)
        after = {"number": before["number"] + 1, "epoch": epoch, "buckets": buckets}
        # written aside and renamed: there is never half a manifest
        fs, aside = self._fs(f"{self.path}/manifest/_{version}")
        fs.mkdirs(aside.getParent())
        stream = fs.create(aside)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        fs.rename(aside, self._fs(f"{self.path}/manifest/{after['number']}")[1])
        self._sweep(set(before["buckets"].values()) | set(buckets.values()), after["number"])

    def _sweep(self, named: set[str], number: int) -> None:
        fs, data = self._fs(f"{self.path}/data")
        for f in fs.listStatus(data):
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
        for old in self._manifests():
            if old < number - 1:
                fs.delete(self._fs(f"{self.path}/manifest/{old}")[1], False)

    def _of(self, df: DataFrame) -> set[str]:
        bucket = F.pmod(F.xxhash64(F.coalesce("host", F.lit("")), F.coalesce("service", F.lit(""))), F.lit(self.buckets))
        return {str(r[0]) for r in df.select(bucket).distinct().collect()}  # at most ``buckets`` numbers

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``. A batch that comes again after a failure is left out."""
        with self.lock:
            before = self.manifest()
            if epoch <= before["epoch"]:
                return
            batch = batch.select(FIELDS).persist()
            touched = self._of(batch)
            if touched:
                known = self._table({b: v for b, v in before["buckets"].items() if b in touched})
                self._replace(before, snapshot(known.unionByName(batch)), touched, epoch)
            batch.unpersist()

    def expire(self, now: float) -> None:
        """Move what is too old to ``expired``, in state expired."""
        with self.lock:
            before = self.manifest()
            table = self._table(before["buckets"])
            touched = self._of(table.filter(is_old(F.lit(now))))
            if not touched:
                return
            known = self._table({b: v for b, v in before["buckets"].items() if b in touched}).persist()
            live, gone = expire(known, now)
            gone.write.mode("append").parquet(f"{self.path}/expired")
            self._replace(before, live, touched, before["epoch"])
            known.unpersist()

    def expired_events(self) -> DataFrame:
        """A stream of what ``expire`` moves."""
        fs, at = self._fs(f"{self.path}/expired")
        fs.mkdirs(at)
        return self.spark.readStream.schema(EVENT).parquet(f"{self.path}/expired")


def upsert(index_path: str):
    """A ``foreachBatch`` function that keeps the whole index as one Parquet table per micro-batch, ``v<epoch>``; small indexes only, see LiveIndex.

    The table before the newest one stays, older ones go.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(index_path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        done = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) < epoch and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{index_path}/{n}/_SUCCESS")))
        events = batch.select(FIELDS)
        both = spark.read.parquet(f"{index_path}/v{done[-1]}").unionByName(events) if done else events
        snapshot(both).write.mode("overwrite").parquet(f"{index_path}/v{epoch}")
        for old in done[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{index_path}/v{old}"), True)

    return write
