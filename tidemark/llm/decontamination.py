"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased, stripped of everything but letters and digits, and hashed.
A seed is a fixed mask over SPAN places that ignores some of them; all masks are
hashed at every place of test items and documents, so a shared passage gives a
common seed even where words were exchanged: of 11 equal words or more, among
which no more than every fourth is another one, some mask meets equal words only.
Items of under LEAST_SEEDED words are cut into one part more than words may differ,
so one of the parts is whole; these are their seeds. Each hit fixes an alignment (item,
shift); along it the best-scoring segment (1 for an equal word, -1 for another)
is the overlap. It counts if ``share`` of its words are equal, and ``min_matches`` in all,
or ``share`` of the item where that is less.

A benchmark of up to ``slice_chars`` characters, a checked size, goes to every task, and documents
are read once without any shuffle. A larger one is joined by its hashes: a bit map of bounded size keeps
most seeds of documents at home, the others meet the items' seeds in a join that Spark may split where a seed is
frequent, and each (document, item, shift) is verified once on the words that lie along it. Either way documents are
read a fixed number of times, however large the benchmark.

Results for odd input: null and empty texts overlap with nothing, items of under
MIN_ITEM words take no part. Every item that a document overlaps with is
reported, once for each document row and item, with its longest overlap (of equal ones the first).
Repeated documents are reported each; repeated items once for each item id. Rows of one doc_id with
different texts are judged each, also by ``remove``. An empty table on either side gives no overlaps. Other
columns, of any name, pass through ``remove`` and are ignored by ``overlaps``. Long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, encode_words, hash_words, slices, tables
from tidemark.llm.setjoin import bitmap, has

#: Fixed masks over eight places: five count, three are ignored. Found by search; tests go through all patterns that SHARE accepts.
MASKS = ("11010011", "00101111", "11101100", "01110101")
MIN_ITEM = 8
#: Words from which on an accepted overlap has the 11 equal words that the masks need.
LEAST_SEEDED = 14
MIN_MATCHES = 12
SHARE = 0.75
SLICE_CHARS = 16_000_000
FILTER_BITS = 22
#: Common seeds that are gone through at once.
HITS = 500_000
PLACES = ("item_id", "doc_start", "doc_end", "item_start", "item_end", "matches")

OTHER = re.compile(r"[\W_]+")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, word hashes); a chunk between white space is one word, without its punctuation."""
    offsets, codes, names = encode_words(texts, lower=False)
    bare = [n if n.isalnum() and n.islower() else OTHER.sub("", n.lower()) for n in names]
    keep = np.array([bool(n) for n in bare], bool)[codes] if len(codes) else np.zeros(0, bool)
    h = hash_words(bare)[codes][keep] if len(codes) else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.cumsum(keep)])[offsets], h


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place of h that has its number of words from there on."""
    n = max(0, len(h) - len(mask) + 1)
    acc = np.full(n, int("1" + mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                acc = (acc * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : i + n]
                acc ^= acc >> np.uint64(29)
    return acc * np.uint64(0xBF58476D1CE4E5B9)


def parts(n: int) -> list[tuple[int, int]]:
    """Start and end of the parts of an item of n words, one of which is whole in each overlap."""
    count = n - math.ceil(SHARE * n) + 1
    edges = [n * k // count for k in range(count + 1)]
    return list(zip(edges, edges[1:]))


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the segment with the highest score (equal 1, other -1)."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


class Index:
    """Seeds of a slice of test items."""

    def __init__(self, ids: list[int], texts: list[str]):
        offsets, h = tokens(pa.array(texts, pa.large_string()))
        self.ids, self.words = [], []
        self.masks: dict[str, None] = {}  # those in use
        found, item, place = [], [], []
        for i, doc in enumerate(ids):
            own = h[offsets[i] : offsets[i + 1]]
            if len(own) < MIN_ITEM:
                continue
            if len(own) < LEAST_SEEDED:
                new = [("1" * (b - a), a, seeds(own[a:b], "1" * (b - a))) for a, b in parts(len(own))]
            else:
                new = [(m, 0, seeds(own, m)) for m in MASKS]
            for m, a, s in new:
                self.masks[m] = None
                found.append(s)
                item.append(np.full(len(s), len(self.ids)))
                place.append(a + np.arange(len(s)))
            self.ids.append(doc)
            self.words.append(own)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.seed, self.item, self.place = cat(found, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(place in h, item, place in item, words from there on) of all common seeds, about HITS at a time."""
        for m in self.masks:
            s = seeds(h, m)
            at = np.flatnonzero(self.maybe[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seed, s[at], "left"), np.searchsorted(self.seed, s[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            part = (np.cumsum(n) - n) // HITS
            for edge in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                c = n[edge]
                k = np.repeat(lo[edge] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                yield np.repeat(at[edge], c), self.item[k], self.place[k], len(m)

    def overlaps(self, texts: pa.Array, min_matches: int, share: float) -> Iterator[tuple]:
        """(row, item id, start and end in the text's words, start and end in the item's, equal words)."""
        offsets, h = tokens(texts)
        for at, item, place, span in self.hits(h):
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = at + span <= offsets[row + 1]
            shift = at - offsets[row] - place
            for r, i, d in np.unique(np.stack([row[inside], item[inside], shift[inside]]), axis=1).T.tolist():
                own, words = h[offsets[r] : offsets[r + 1]], self.words[i]
                lo, hi = max(0, d), min(len(own), d + len(words))
                found = overlap(own[lo:hi] == words[lo - d : hi - d], len(words), min_matches, share)
                if found:
                    start, end, same = found
                    yield r, self.ids[i], lo + start, lo + end, lo + start - d, lo + end - d, same


def overlap(equal: np.ndarray, n: int, min_matches: int, share: float) -> tuple[int, int, int] | None:
    """Start, end and equal words of the overlap along an alignment with an item of n words, if it counts."""
    start, end = best_segment(equal)
    same = int(equal[start:end].sum())
    return (start, end, same) if same >= min(min_matches, share * n) and same >= share * (end - start) else None


def joined_overlaps(work: DataFrame, items: DataFrame, min_matches: int, share: float) -> DataFrame:
    """Overlaps of a benchmark of any size, by a join of seeds. ``work``: none, doc_id, text_hash, text; rows that are the same in all count once."""
    context = work.sparkSession.sparkContext
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for item, own_hash, text in zip(b.column("item_id").to_pylist(), b.column("item_hash").to_pylist(), b.column("text").to_pylist()):
                own = Index([item], [text])
                if own.words:
                    words = own.words[0]
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([item], pa.int64()), "item_hash": pa.array([own_hash], pa.int64()), "n": pa.array([len(words)], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()), "masks": pa.array([list(own.masks)], pa.list_(pa.string())), "seeds": pa.array([own.seed.view(np.int64)], pa.list_(pa.int64())), "places": pa.array([own.place], pa.list_(pa.int64()))})

    known = cut(items.mapInArrow(index, "item_id long, item_hash long, n long, words binary, masks array<string>, seeds array<long>, places array<long>").dropDuplicates(["item_id", "item_hash"]))
    masks = sorted(r[0] for r in known.select(F.explode("masks")).distinct().collect())  # of a fixed few
    item_seeds = known.select("item_id", "item_hash", F.explode(F.arrays_zip("seeds", "places")).alias("z")).select("item_id", "item_hash", F.col("z.seeds").alias("seed"), F.col("z.places").alias("place"))
    maybe = context.broadcast(bitmap(item_seeds.select(F.col("seed").alias("key")).distinct(), each=64))
    keys = ["none", "doc_id", "text_hash"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            offsets, h = tokens(b.column("text"))
            for m in masks:
                s = seeds(h, m)
                at = np.flatnonzero(has(maybe.value, s.view(np.int64)))
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + len(m) <= offsets[row + 1]
                at, row = at[inside], row[inside]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in keys), pa.array(s[at].view(np.int64)), pa.array(at - offsets[row])], names=[*keys, "seed", "at"])

    hits = work.mapInArrow(probe, "none boolean, doc_id long, text_hash long, seed long, at long")
    met = cut(hits.join(item_seeds, "seed").select(*keys, "item_id", "item_hash", (F.col("at") - F.col("place")).alias("shift")).distinct())
    wanted = context.broadcast(bitmap(met.select(F.xxhash64(*keys).alias("key")).distinct()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.filter(pa.array(has(wanted.value, b.column("key").to_numpy())))
            if b.num_rows:
                offsets, h = tokens(b.column("text"))
                words = [h[lo:hi].tobytes() for lo, hi in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(np.diff(offsets)), pa.array(words, pa.binary())], names=[*keys, "m", "own"])

    own = work.withColumn("key", F.xxhash64(*keys)).mapInArrow(fetch, "none boolean, doc_id long, text_hash long, m long, own binary").dropDuplicates(keys)
    pairs = met.join(own, keys).join(known.select("item_id", "item_hash", "n", "words"), ["item_id", "item_hash"])
    lo, hi = F.greatest(F.lit(0), "shift"), F.least("m", F.col("shift") + F.col("n"))
    part = lambda c, at: F.substring(c, (8 * at + 1).cast("int"), (8 * (hi - lo)).cast("int"))
    along = pairs.select(*keys, "item_id", "shift", "n", lo.alias("lo"), part(F.col("own"), lo).alias("x"), part(F.col("words"), lo - F.col("shift")).alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, rows = [], []
            columns = (b.column(c).to_pylist() for c in ("shift", "n", "lo", "x", "y"))
            for k, (d, n, at, x, y) in enumerate(zip(*columns)):
                found = overlap(np.frombuffer(x, np.uint64) == np.frombuffer(y, np.uint64), n, min_matches, share)
                if found:
                    pick.append(k)
                    rows.append((at + found[0], at + found[1], at + found[0] - d, at + found[1] - d, found[2]))
            names = ["doc_start", "doc_end", "item_start", "item_end", "matches"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(pick, pa.int64())) for c in (*keys, "item_id", "shift")), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], names=[*keys, "item_id", "shift", *names])

    places = ["doc_start", "doc_end", "item_start", "item_end", "matches"]
    sure = along.mapInArrow(verify, "none boolean, doc_id long, text_hash long, item_id long, shift long, " + ", ".join(f"{c} long" for c in places))
    best = sure.groupBy(*keys, "item_id").agg(F.max_by(F.struct(*places), F.struct("matches", -F.col("shift"))).alias("best"))
    return best.select(*keys, "item_id", "best.*")


def found_overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int, share: float, slice_chars: int) -> DataFrame:
    """Overlaps by none (doc_id is null), doc_id (then 0) and text_hash of the document row."""
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    work = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    if total > slice_chars:
        rows = work.select("none", "doc_id", "text_hash")
        return rows.join(joined_overlaps(work, items, min_matches, share), ["none", "doc_id", "text_hash"])
    held = sorted((r["item_id"], r["text"]) for r in items.collect())  # slice_chars at most
    sent = docs.sparkSession.sparkContext.broadcast(([i for i, _ in held], [t for _, t in held]))
    names = ["none", "doc_id", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for b in slices(batches, "text"):
            best: dict[tuple, tuple] = {}
            for r, item, *rest in index.overlaps(b.column("text"), min_matches, share):
                # longest first, then by place
                if (r, item) not in best or (-rest[-1], rest[0] - rest[2]) < (-best[r, item][-1], best[r, item][0] - best[r, item][2]):
                    best[r, item] = tuple(rest)
            at = pa.array([r for r, _ in best], pa.int64())
            rows = [(item, *rest) for (_, item), rest in best.items()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names), *(pa.array(c, pa.int64()) for c in columns)], names=[*names, *PLACES])

    return work.mapInArrow(run, "none boolean, doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in PLACES))


def overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, share: float = SHARE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document row and test item that overlap, with the longest overlap."""
    found = found_overlaps(docs, benchmark, min_matches, share, slice_chars)
    return found.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), *PLACES)


def remove(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, share: float = SHARE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents that overlap with no test item, all columns. Rows whose doc_id is null stay."""
    found = found_overlaps(docs, benchmark, min_matches, share, slice_chars).filter("not none")
    mark = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text")).distinct()
    own = docs.withColumn("__hash", F.xxhash64("text"))
    return own.join(mark, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__hash") == F.col("__text")), "left_anti").select(docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
