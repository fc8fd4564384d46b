"""Best-fit packing of tokenised documents by swap-based local search.

A document's tokens (plus an end id) become pieces: documents longer than a
sequence are cut into whole sequences and a rest. Whole sequences stand alone.
The rests are dealt at random into groups of bounded size; each group is packed
best-fit decreasing and then improved: underfull bins exchange one piece for
one, one for two, or move a piece, whenever that raises the sum of squared
fills, until bins run empty. Groups see lengths only, never tokens.

Results for odd input: null and empty texts are one end id. An empty table
gives no rows. Rows whose doc_id is null, and repeated rows, are packed each. Rows
are dealt to groups by chance of their place in the table, whatever their ids, so equal ids fill no
group; which documents share a sequence follows the order of rows. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter, or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, encode_words, row_of, slices, tables

#: Pieces that one packing task may get, about.
GROUP_PIECES = 50_000
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 250_000
#: Words whose ids are put in place at once, and bytes of text that are tokenised at once.
STEP_WORDS, PIECE_CHARS = 100_000, 4_000_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids by a tokenizer whose pre-tokenizer splits at white space and between letters and punctuation.

    Such a tokenizer gives a text the ids of its parts, one after the other, so each
    distinct part is encoded once. A chunk between white space is cut into a word
    of letters and the marks behind it; other chunks stay whole. Words of letters are
    encoded many at a time: each ends in exactly one word-end id, which tells them
    apart again.
    """

    #: Marks that may be cut off behind a word.
    MARKS = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 18, np.int64)
        self.used = 0

    def add(self, flat: np.ndarray, size: np.ndarray, parts: list[str]) -> None:
        n, end = len(self.place), self.used + len(flat)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(parts) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[self.used : end] = flat
        self.begin[n + 1 : n + 1 + len(parts)] = self.used + np.cumsum(size)
        self.place.update(zip(parts, range(n, n + len(parts))))
        self.used = end

    def add_words(self, words: list[str]) -> None:
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            flat = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.is_end[flat])
            if len(ends) == len(part):
                self.add(flat, np.diff(ends, prepend=-1), part)
            else:
                self.add_parts(part)

    def add_parts(self, parts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int64)
        self.add(np.array([i for x in found for i in x], np.uint32), size, parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by text, ids) of all texts."""
        offsets, codes, chunks = encode_words(texts, lower=False)
        if len(self.place) > CACHE_WORDS:
            self.clear()
        words, tails = [], []
        for chunk in chunks:
            if chunk.isalpha():
                words.append(chunk.lower() if chunk.isascii() else chunk)
                tails.append("")
                continue
            word = chunk.rstrip(self.MARKS)
            if word.isalpha():
                words.append(word.lower() if word.isascii() else word)
                tails.append(chunk[len(word) :])
            else:
                words.append(chunk)
                tails.append("")
        new = {w for w in words if w not in self.place}
        self.add_words(alpha := sorted(w for w in new if w.isalpha()))
        self.add_parts(sorted((new | set(tails)).difference(alpha, self.place)))
        head = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
        tail = np.fromiter(map(self.place.__getitem__, tails), np.int32, len(tails))
        del chunks, words, tails, new, alpha
        if not len(codes):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        size = np.diff(self.begin[: len(self.place) + 1]).astype(np.int32)
        edges = np.concatenate([[0], np.cumsum((size[head] + size[tail])[codes], dtype=np.int64)])
        ids = np.empty(int(edges[-1]), np.uint32)
        for lo in range(0, len(codes), STEP_WORDS):  # only the ids themselves are ever held for all words
            part = codes[lo : lo + STEP_WORDS]
            units = np.stack([head[part], tail[part]], axis=1).ravel()
            many = size[units]
            own = ids[edges[lo] : edges[lo + len(part)]]
            own[:] = self.ids[np.repeat(self.begin[units] - (np.cumsum(many, dtype=np.int64) - many), many) + np.arange(len(own))]
        return edges[offsets], ids


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, kept over its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids``, array<int>, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for b in slices(batches, "text", PIECE_CHARS):
            offsets, ids = tokenizer.encode(b.column("text"))
            doc_ids = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, doc in enumerate(doc_ids):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, lo in enumerate(range(0, len(own), max_tokens)):
                    part = own[lo : lo + max_tokens]
                    rows.append((doc, k, lo, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            del b, ids  # else held while the next batch is read
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over integer lengths: for each bin, its items. Bins are kept by free space."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit s: a bin with s tokens free
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = has >> n
        if fit:
            space = n + ((fit & -fit).bit_length() - 1)
            b = by_space[space].pop()
            if not by_space[space]:
                has &= ~(1 << space)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_space[space - n].append(b)
        has |= 1 << (space - n)
    return bins


def exchange(n: list[int], taker: list[int], own: dict[int, int], pairs: dict[int, tuple[int, int]], space: int) -> tuple[list[int], list[int]]:
    """The items of the donor, one or two, and the taker's one, whose exchange fills the taker most; empty if none does."""
    best, out, back = 0, [], []
    tables = [(sorted(own), lambda x: [own[x]]), (sorted(pairs), lambda x: list(pairs[x]))]
    for j in taker:
        for table, find in tables:
            k = bisect_right(table, n[j] + space) - 1
            if k >= 0 and table[k] - n[j] > best:
                best, out, back = table[k] - n[j], find(table[k]), [j]
    return out, back


def pair_sums(n: list[int], items: list[int], most: int) -> dict[int, tuple[int, int]]:
    """For each sum of two items' lengths, up to ``most``, two such items. Only distinct lengths are gone through, so there are at most ``most`` squared pairs."""
    by_length: dict[int, list[int]] = {}
    for i in items:
        if len(own := by_length.setdefault(n[i], [])) < 2:
            own.append(i)
    sizes = sorted(by_length)
    out: dict[int, tuple[int, int]] = {}
    for k, a in enumerate(sizes):
        if 2 * a > most:
            break
        if len(by_length[a]) > 1:
            out.setdefault(2 * a, tuple(by_length[a]))
        for b in sizes[k + 1 : bisect_right(sizes, most - a)]:
            out.setdefault(a + b, (by_length[a][0], by_length[b][0]))
    return out


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A bound: no packing has fewer bins. Pieces above half a bin share none; what they leave free takes only the smaller ones that fit beside them."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    many, size = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)  # pieces below k are left out; those above capacity - k leave room for no other
    small = size[half] - np.where(k > 0, size[k - 1], 0)
    free = (many[capacity - k] - many[half]) * capacity - (size[capacity - k] - size[half])
    return int((many[-1] - many[half]) + max(0, (-((free - small) // capacity)).max()))


def offer(n: list[int], items: list[int]) -> int:
    """Bit x: one item of the bin, or two together, have length x."""
    own = pairs = twice = 0
    for i in items:
        if not twice >> n[i] & 1:
            pairs |= own << n[i]
            twice |= own & 1 << n[i]
            own |= 1 << n[i]
    return own | pairs


def want(n: list[int], items: list[int], space: int) -> int:
    """Bit x: the bin is filled more by getting length x, beside its items or for one of them."""
    out = run = (1 << space) - 1
    for j in {n[i] for i in items}:
        out |= run << j
    return out << 1


def givers(order: list[tuple[int, int]], offers: dict[int, int], wants: dict[int, int]) -> list[int]:
    """The bins that a bin at least as full can take from, the fullest first; ``order``: (space, bin), sorted.

    One pass over all bins: what the fuller ones want together is held against what a bin offers.
    """
    out, wanted = [], 0
    for _, level in groupby(order, key=itemgetter(0)):
        same = [b for _, b in level]
        later = list(accumulate((wants[b] for b in reversed(same)), or_, initial=0))  # of bins as full, all but the bin itself count
        for b in same:
            later.pop()
            if offers[b] & (wanted | later[-1]):
                out.append(b)
            wanted |= wants[b]
    return out


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Try to empty the least full bins by moves and by one-for-one and two-for-one exchanges.

    Each accepted step raises the sum of squared fills: the donor's fill falls, a bin at least
    as full gains as much. A bin that runs empty is dropped. Of the bins that can give, the least
    full give first. The search ends when none of all bins can, or no packing has fewer.
    """
    bins = [b for b in bins if b]
    n, used, least = [int(x) for x in lengths], len(bins), least_bins(lengths, capacity)
    if used <= least:
        return bins
    space = [capacity - sum(n[i] for i in b) for b in bins]
    order = sorted((s, b) for b, s in enumerate(space) if s)
    offers = {b: offer(n, bins[b]) for _, b in order}
    wants = {b: want(n, bins[b], s) for s, b in order}

    def place(b: int, gain: int) -> None:
        nonlocal used
        order.pop(bisect_left(order, (space[b], b)))
        space[b] -= gain
        used -= not bins[b]
        if space[b] and bins[b]:
            insort(order, (space[b], b))
            offers[b], wants[b] = offer(n, bins[b]), want(n, bins[b], space[b])

    while used > least and (able := givers(order, offers, wants)):
        for donor in reversed(able):
            # the fullest bins first: raising these raises the squares most
            for s, b in order[: bisect_right(order, (space[donor], len(bins)))]:
                if b == donor or not offers[donor] & wants[b]:
                    continue
                own = {n[i]: i for i in bins[donor]}
                move = max((x for x in own if x <= s), default=0)
                out, back = ([own[move]], []) if move else exchange(n, bins[b], own, pair_sums(n, bins[donor], capacity), s)
                for i in out:
                    bins[donor].remove(i)
                    bins[b].append(i)
                for j in back:
                    bins[b].remove(j)
                    bins[donor].append(j)
                gain = sum(n[i] for i in out) - sum(n[j] for j in back)
                place(b, gain)
                place(donor, -gain)
                if not bins[donor]:
                    break
            if used <= least:
                break
    return [b for b in bins if b]


def pack(cut_pieces: DataFrame, max_tokens: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces.

    sequence_id = group << 32 | bin, so groups number their bins alone.
    """
    spark = cut_pieces.sparkSession
    n = cut_pieces.filter(F.col("length") < max_tokens).count()
    groups = max(1, -(-n // group_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        if lengths[0] >= max_tokens:  # a salted share of the whole sequences
            sequence, offset = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        else:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for b, items in enumerate(local_search(lengths, best_fit(lengths, max_tokens), max_tokens)):
                items = sorted(items)
                sequence[items] = b
                offset[items] = np.cumsum(lengths[items]) - lengths[items]
        pdf["sequence_id"] = (pdf["grp"].to_numpy() << 32) | sequence
        pdf["offset"] = offset
        return pdf.drop(columns="grp")

    rest = cut_pieces.filter(F.col("length") < max_tokens).withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # of a kept table: the same if a task runs again
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in cut_pieces.schema.fields) + "sequence_id long, offset long"
    packed = rest.groupBy("grp").applyInPandas(run, schema)
    # A whole sequence needs no partner: its id follows from the row alone, above all groups.
    whole = cut_pieces.filter(F.col("length") >= max_tokens).withColumn("sequence_id", (F.lit(groups).cast("long") + 1) * F.lit(1 << 32) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = 4096, with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenise, cut and pack whole documents; tokens are computed once and kept in the shared folder."""
    return pack(cut(pieces(docs, tokenizer_path or tokenizer_file(), max_tokens, with_ids=with_ids)), max_tokens, group_pieces)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces packed with ids: sequence_id, input_ids, doc_ids, starts (of each document's tokens)."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    out = packed.groupBy("sequence_id").agg(rows.alias("r"))
    return out.select("sequence_id", F.flatten("r.ids").alias("input_ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("starts"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(tables(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
