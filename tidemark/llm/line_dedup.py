"""Line dedup by an exact set-similarity join of all lines of all documents.

A line is the set of its words (A-Z as a-z). Words are ordered by rarity; prefix,
positional and length filters give candidates, Jaccard is verified on whole sets.
A line goes if an earlier line, by (doc_id, line number), is as similar as the
threshold, whether or not that one stays itself. Lines with fewer than
``least_words`` different words are too short to tell and always stay.

Equal sets are one class from the start: of each class only its first line can
stay, and stays unless the first line of another class before it is similar.

Results for odd input: null and empty texts have no such lines and stay as they
are. Rows whose doc_id is null are left alone. Repeated rows of one doc_id count
as one document. An empty table gives no rows; other columns pass through
``dedup_lines``, whatever their names; columns named like the two it adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import setjoin
from tidemark.llm.common import cut, discard, release, slices, stored, tables
from tidemark.llm.words import Texts, distinct

LEAST_WORDS = 5
THRESHOLD = (80, 100)


def line_units(least_words: int, text: str = "text") -> setjoin.Units:
    def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        texts = Texts(batch.column(text))
        row, number, offsets = texts.lines()
        offsets, token = distinct(np.repeat(np.arange(len(row)), np.diff(offsets)), texts.hash, len(row))
        size = np.diff(offsets)
        long = size >= least_words
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        return doc[row[long]], number[long], np.concatenate([[0], np.cumsum(size[long])]), token[np.repeat(long, size)]

    return units


def candidate_lines(docs: DataFrame, units: setjoin.Units, threshold: setjoin.Threshold) -> DataFrame:
    codes = setjoin.sketch(docs, lambda b: Texts(b.column("text")).hash)
    return setjoin.candidates(setjoin.postings(docs, units, codes, threshold, drop_single=True, class_rows=True), threshold, setjoin.CAP)


def join_lines(found: DataFrame, docs: DataFrame, units: setjoin.Units, threshold: setjoin.Threshold) -> tuple[DataFrame, DataFrame]:
    """(sig, doc, line: the first line of each class; sig of every class that has a similar class before it)."""
    first = setjoin.of_kind(found, setjoin.CLASS, ("sig", "doc", "line"))
    pairs = cut(setjoin.pairs_of(found))
    sets = cut(setjoin.fetch_sets(pairs, docs, units))
    later = lambda found: cut(found.select(F.col("sig2").alias("sig")).distinct())
    sure = later(setjoin.verify(setjoin.earliest(pairs), sets, threshold))
    rest = pairs.select("sig", "sig2").join(setjoin.earliest(pairs), ["sig", "sig2"], "left_anti").join(sure.withColumnRenamed("sig", "sig2"), "sig2", "left_anti")
    sure = sure.unionByName(later(setjoin.verify(rest, sets, threshold)))
    # second round: classes that none of their first candidates matched and that have more in a group, against all others of these groups
    short = setjoin.short_rows(found).join(sure, "sig", "left_anti")
    if short.isEmpty():
        return first, sure
    label = F.lit(0).cast("long")  # the others are only held against
    done = setjoin.short_rows(found).join(sure, "sig", "left_semi").unionByName(setjoin.whole_rows(found))
    rows = short.withColumn("label", F.col("sig")).unionByName(done.withColumn("label", label))
    maps = lambda long: setjoin.fetch_sets(long, docs, units, maps=True, bits=setjoin.MAP_BITS)
    more = setjoin.pairs_of(setjoin.candidates(setjoin.reopened(rows, maps), threshold, None))
    more = cut(more.join(pairs.select("sig", "sig2"), ["sig", "sig2"], "left_anti"))
    if more.isEmpty():
        return first, sure
    return first, sure.unionByName(later(setjoin.verify(more, setjoin.fetch_sets(more, docs, units), threshold)))


def kept_lines(docs: DataFrame, least_words: int = LEAST_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, kept: the numbers of those long enough lines that stay, for documents that keep any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    units = line_units(least_words)
    t = setjoin.Threshold(*threshold)
    found, at = stored(candidate_lines(docs, units, t))
    release(docs)
    first, gone = join_lines(found, docs, units, t)
    stay = first.join(gone, "sig", "left_anti")
    kept = cut(stay.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("line").alias("kept")))
    discard(docs.sparkSession, at)
    return kept


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """All rows and columns, ``text`` without the lines that go; ``lines_removed`` (numbers) and ``lines_left`` (long enough ones) are added."""
    kept = kept_lines(docs, least_words, threshold)
    names = [c for c in docs.columns if c not in ("lines_removed", "lines_left")]
    own = "kept"
    while own in names:
        own += "_"
    kept = kept.withColumnRenamed("kept", own)
    work = docs.select(*(f"`{c}`" for c in names)).join(kept, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            kept = pc.fill_null(pc.list_value_length(b.column(own)), 0)
            lines = pc.add(pc.count_substring(pc.fill_null(b.column("text"), ""), "\n"), 1)
            # only where some line is not among the kept ones there is anything to look for
            some = pc.and_(pc.not_equal(lines, kept), pc.is_valid(b.column("doc_id")))
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            picked = b.take(pa.array(at))
            removed: list[list[int]] = [[]] * b.num_rows
            changed, texts = np.zeros(b.num_rows, bool), []
            for r, text, keep in zip(at.tolist(), picked.column("text").to_pylist(), picked.column(own).to_pylist()):
                lines, keep = (text or "").split("\n"), set(keep or [])
                # bytes split and lower just as the units do: ASCII white space, A-Z
                gone = [i for i, x in enumerate(lines) if i not in keep and len(x) >= 2 * least_words - 1 and len(set(x.encode().lower().split())) >= least_words]
                if gone:
                    removed[r], changed[r], out = gone, True, set(gone)
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in out))
            text = pc.replace_with_mask(b.column("text"), pa.array(changed), pa.array(texts, b.schema.field("text").type))
            columns = [text if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.list_(pa.int32())), kept.cast(pa.int64())], names=[*names, "lines_removed", "lines_left"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.drop(own).schema.fields)
    return work.select(*(f"`{c}`" for c in names), own).mapInArrow(run, f"{fields}, lines_removed array<int>, lines_left long")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the numbers of the lines that go, how many long enough ones are left, and the SHA-256 of the text that stays."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.size("lines_removed").cast("long").alias("n_removed"), "lines_left", F.array_join(F.transform("lines_removed", lambda x: x.cast("string")), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as t, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) as i from documents),
w as (select doc_id, i, t, list_distinct([x for x in string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+') if x <> '']) g from l),
o as (select doc_id, i, list_sort(g) as h from w where len(g) >= 5),
c as (select h as g, min((doc_id, i)) as f, len(h) as n from o group by h),
u as (select f, n, unnest(g) t from c),
m as (select distinct b.f from u a join u b on a.t = b.t and a.f < b.f and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      group by a.f, b.f, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
k as (select f from c where f not in (select f from m)),
z as (select w.*, len(g) >= 5 as long, len(g) >= 5 and (doc_id, i) not in (select f from k) as gone from w)
select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where long and not gone) as lines_left,
       coalesce(string_agg(cast(i as varchar), ',' order by i) filter (where gone), '') as removed,
       sha256(coalesce(string_agg(t, chr(10) order by i) filter (where not gone), '')) as text_sha256 from z group by doc_id
"""
