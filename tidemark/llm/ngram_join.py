"""N-gram Jaccard join of documents under several global token orders.

A document is the set of its word n-grams. Documents with the same set are one
class. Two classes can only reach the threshold if their prefixes share a token under
every global order of tokens; so candidates are met under each order (rare
tokens first, and random ones, frequent tokens last in each), and only pairs met under
all are verified on whole sets. Links give connected components.

Families of near copies do not make all their pairs: see ``setjoin``. A second round
goes through what the first left open, leaving out pairs that are already connected,
so components are exact.

Results for odd input: null or empty text, or one without words, has the empty set
(n_shingles 0) and is linked with nothing. Rows whose doc_id is null get component
null. Repeated rows give a row each. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import setjoin
from tidemark.llm.common import TEXT_CHARS, cut, discard, mix, release, slices, stored, tables
from tidemark.llm.components import components
from tidemark.llm.words import Texts, distinct, shingles, signatures

ORDERS = 2


def document_units(k: int, text: str = "text") -> setjoin.Units:
    def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        return doc, np.zeros(len(doc), np.int64), *distinct(*shingles(Texts(batch.column(text)), k), len(doc))

    return units


def classes(docs: DataFrame, units: setjoin.Units) -> DataFrame:
    """doc_id, text_hash, n_shingles, sig and check (64 bits each, of the set) of every row; sig is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_CHARS):
            doc, _, offsets, token = units(b)
            sig, b0, b1 = signatures(offsets, token)
            n = np.diff(offsets)
            check = setjoin.signed(mix(b0) ^ b1 ^ (n.astype(np.uint64) << np.uint64(20)))
            yield pa.RecordBatch.from_arrays([pa.array(doc), b.column("text_hash"), pa.array(n), pa.array(setjoin.signed(sig), mask=n == 0), pa.array(check)], names=["doc_id", "text_hash", "n_shingles", "sig", "check"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, sig long, check long")


def links(docs: DataFrame, k: int, threshold: setjoin.Threshold, orders: int = ORDERS) -> DataFrame:
    """Verified links (sig, sig2) whose connected components are those of all links."""
    units = document_units(k)
    full = (1 << orders) - 1
    codes = setjoin.sketch(docs, lambda b: shingles(Texts(b.column("text")), k)[1])
    found, only, kept_at = None, None, []
    for order in range(orders):  # each order posts only what candidates under the one before may still need
        now, at = stored(setjoin.candidates(setjoin.postings(docs, units, codes, threshold, order, only), threshold, setjoin.CAP))
        kept_at.append(at)
        release(docs)
        named = setjoin.of_kind(now, setjoin.PAIR, setjoin.PAIR_COLUMNS).select(F.explode(F.array("sig", "sig2")).alias("key"))
        only = setjoin.bitmap(named.unionByName(setjoin.open_rows(now).select(F.col("sig").alias("key"))))
        found = now if found is None else found.unionByName(now)
    met = cut(setjoin.pairs_of(found))
    every_order = F.col("bits").bitwiseAND(full) == full
    pairs = met.filter(every_order)
    # of long sets, most pairs that met by chance go here, before any set is moved
    kept = cut(setjoin.sift(pairs, cut(setjoin.fetch_sets(pairs, docs, units, maps=True)), threshold))
    pairs = cut(pairs.join(kept, ["sig", "sig2"], "left_semi"))
    sets = cut(setjoin.fetch_sets(pairs, docs, units))
    release(docs)
    # one pair for each later class, then those pairs that the links found do not connect
    sure = cut(setjoin.verify(setjoin.earliest(pairs), sets, threshold))
    rest = unconnected(pairs.select("sig", "sig2").join(setjoin.earliest(pairs), ["sig", "sig2"], "left_anti"), sure)
    sure = sure.unionByName(cut(setjoin.verify(rest, sets, threshold)))
    open_rows = setjoin.open_rows(found)
    if open_rows.isEmpty():
        for at in kept_at:
            discard(docs.sparkSession, at)
        return sure
    # second round: what groups left open, between what is not yet connected
    open_rows = open_rows.join(labels(sure), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    maps = lambda long: setjoin.fetch_sets(long, docs, units, maps=True, bits=setjoin.MAP_BITS)
    more = setjoin.candidates(setjoin.reopened(open_rows, maps), threshold, None)
    again = met.unionByName(setjoin.pairs_of(more))
    again = again.groupBy("sig", "sig2").agg(F.bit_or("bits").alias("bits"), *(F.min(c).alias(c) for c in ("doc", "line", "doc2", "line2")))
    again = cut(again.filter(every_order).join(met.filter(every_order).select("sig", "sig2"), ["sig", "sig2"], "left_anti"))
    for at in kept_at:
        discard(docs.sparkSession, at)
    if again.isEmpty():
        return sure
    return sure.unionByName(cut(setjoin.verify(again, setjoin.fetch_sets(again, docs, units), threshold)))


def labels(edges: DataFrame) -> DataFrame:
    """sig, label of every class that a link names."""
    return components(edges.select(F.col("sig").alias("a"), F.col("sig2").alias("b"))).select(F.col("node").alias("sig"), F.col("root").alias("label"))


def unconnected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components of the edges."""
    label = cut(labels(edges))
    out = pairs.join(label.withColumnRenamed("label", "l1"), "sig", "left").join(label.select(F.col("sig").alias("sig2"), F.col("label").alias("l2")), "sig2", "left")
    return cut(out.filter(F.coalesce("l1", "sig") != F.coalesce("l2", "sig2")).select("sig", "sig2"))


def grouped(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), orders: int = ORDERS) -> DataFrame:
    """doc_id, text_hash, n_shingles, root and rest, component_id of every row whose doc_id is not null.

    ``root`` and ``rest`` name the group of linked sets, also where different groups hold rows of one doc_id; root is null for the empty set.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    own = cut(classes(known, document_units(k)))
    smallest = own.filter("sig is not null").groupBy("sig", "check").agg(F.min("doc_id").alias("least"))
    found = links(known, k, setjoin.Threshold(*threshold), orders)
    label = cut(components(found.select(F.col("sig").alias("a"), F.col("sig2").alias("b"))))
    of_class = smallest.join(label.withColumnRenamed("node", "sig"), "sig", "left")
    # a class without links is a group by all its bits
    of_class = of_class.withColumn("rest", F.when(F.col("root").isNull(), F.col("check")).otherwise(0)).withColumn("root", F.coalesce("root", "sig"))
    of_root = of_class.groupBy("root", "rest").agg(F.min("least").alias("component_id"))
    of_class = cut(of_class.join(of_root, ["root", "rest"]).select("sig", "check", "root", "rest", "component_id"))
    return own.join(of_class, ["sig", "check"], "left").select("doc_id", "text_hash", "n_shingles", "root", "rest", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_documents(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked, itself included) of every row."""
    out = grouped(docs, k, threshold, orders).select("doc_id", "n_shingles", "component_id")
    none = classes(docs.filter("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text"), document_units(k))
    return out.unionByName(none.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), orders: int = ORDERS) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the row with the smallest doc_id stays, of equal ids the one with the smallest hash of its text.

    Rows whose doc_id is null stay, and rows without shingles; rows that repeat doc_id and text are one.
    """
    group = grouped(docs, k, threshold, orders)
    first = group.filter("root is not null").groupBy("root", "rest").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("x.*")
    first = first.unionByName(group.filter("root is null").select("doc_id", "text_hash").distinct())
    known = docs.filter("doc_id is not null").withColumn("__hash", F.xxhash64("text"))
    mark = first.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text"))
    kept = known.join(mark, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__hash") == F.col("__text")), "left_semi").dropDuplicates(["doc_id", "__hash"])
    return kept.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(tables(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


SQL = """
with recursive d as (select doc_id, [w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+') if w <> ''] w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct([w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] for i in range(1, len(w) - 1)])
                          when len(w) > 0 then [array_to_string(w, chr(1))] else cast([] as varchar[]) end g from d),
x as (select doc_id, unnest(g) t, len(g) n from s),
p as (select a.doc_id a, b.doc_id b from x a join x b on a.t = b.t and a.doc_id < b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r(doc_id, root) as (select doc_id, doc_id from s union select e.b, r.root from r join e on e.a = r.doc_id)
select s.doc_id, cast(len(g) as bigint) as n_shingles, (select min(root) from r where r.doc_id = s.doc_id) as component_id from s
"""
