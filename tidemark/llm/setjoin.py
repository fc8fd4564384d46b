"""Exact set-similarity self-join by prefix filtering, for sets of any number and skew.

Sets come as token arrays per *unit* (a document, or a line of one) and are
joined as *classes*: units with the same set share a signature and are one class
from the start (a signature of 64 bits; size and parity maps, of 28 bits at least for sets of five tokens, tell
sets apart that share one). A class posts its prefix - its first tokens under a global
order - and candidates meet where they share a posted token. Filters need no
sets: lengths, the place of the token in both, and parity maps, which bound how
far two sets differ.

A group of one token may be large. Each class then gets only its CAP earliest
candidates from it; the group's rows are kept as *open* rows and gone through
again once the first links are known, for what these left open: dealt to pairs of
blocks by exact counts of their tokens, groups that links have made one are left out, and
parity maps as large as the sets need them go along, so that hardly more pairs
leave a group than have the similarity. Tokens that very many sets hold, by a
sketch of all counts, are dealt to pairs of blocks from the start; a group that
is too large all the same becomes open rows as a whole. No pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TEXT_CHARS, cut, mix, slices, trim
from tidemark.llm.words import distinct, signatures

#: Counters of the frequency sketch (one byte each when sent to tasks).
SKETCH_BITS = 22
CHUNK_BITS = 14
#: Sets in a block of a split token group.
BLOCK = 8_192
#: Sets up to which all pairs of a group are held against each other at once.
SMALL = 256
CAP = 2
#: Signatures a map task remembers, to post each class once.
SEEN = 50_000
#: Documents up to which a list of their ids is sent to every task to select texts.
FEW_DOCUMENTS = 300_000
#: Rows of a block in the second round.
OPEN_BLOCK = 1_024
#: Posted rows of one token from which on a group is not paired in the first round.
LIMIT = 3 * BLOCK
#: Candidate pairs that one NumPy step may hold.
PAIRS = 250_000
#: Bytes of maps that one NumPy step may hold.
MAP_BYTES = 4_000_000
#: Sets of more tokens have a parity map of their own in the second round, of so many bits at most.
MAP_FROM, MAP_BITS = 64, 2_048

#: Columns of posted rows, all long. ``token`` names the group: the ranked token, mixed with its pair of blocks if it is
#: split, or a class's signature. ``at`` has the set's size and the token's place, ``tail`` line and flags.
POSTING = ("token", "at", "tail", "sig", "b0", "b1", "doc")
POSTING_SCHEMA = ", ".join(f"{c} long" for c in POSTING)
#: Flags in ``tail``, under the line: a class row, a row of two blocks, the second of these, and the order.
LINE_SHIFT, IS_CLASS, IS_CROSS, IS_SECOND, ORDER_MASK = 10, 512, 256, 128, 127
#: Kinds of candidate rows: a pair, an open row (a posted row), a class with its first unit, or an open row
#: that the cap cut nothing off: all its earlier candidates in its group are pairs already.
PAIR, OPEN, CLASS, OPEN_WHOLE = 0, 1, 2, 3
PAIR_COLUMNS = ("bits", "line", "line2", "sig", "doc", "sig2", "doc2")
FOUND = ("kind", *(f"c{i}" for i in range(7)))
FOUND_SCHEMA = ", ".join(f"{c} long" for c in FOUND)
#: Posted rows that are taken together, at least; with parity maps, fewer.
CHUNK, CHUNK_MAPS = 125_000, 50_000
BITMAP_BITS = 27

Units = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
"""From a batch: (doc by unit, line by unit, token offsets by unit, each unit's distinct tokens in ascending order)."""


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return -(-self.num * (n + m) // (self.num + self.den))

    def holds(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (n + m - common)


def sketch(df: DataFrame, tokens: Callable[[pa.RecordBatch], np.ndarray], text: str = "text") -> np.ndarray:
    """Codes of how often the tokens of each of 2**SKETCH_BITS buckets occur: about 8 * log2(count + 1).

    Every occurrence counts. What is sent around and to the driver is bounded by the number of buckets.
    """
    chunks = 1 << (SKETCH_BITS - CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held, n = [], 0
        for b in slices(batches, text, TEXT_CHARS):
            held.append((tokens(b) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            n += len(held[-1])
            if n > 4 * PAIRS:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        for c in range(chunks):
            part = total[c << CHUNK_BITS : (c + 1) << CHUNK_BITS]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [part[at].astype("<u4").tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        code = np.minimum(255, np.floor(8 * np.log2(total + 1.0))).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "code": pa.array([code.tobytes()], pa.binary())})

    rows = df.mapInArrow(count, "chunk int, at binary, n binary").groupBy("chunk").applyInArrow(add, "chunk int, code binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(bytes(r["code"]), np.uint8)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def ordered_by(order: int, token: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A global order's rank of tokens, itself the token's name there: order 0 puts rare ones first, others are random.

    Frequent tokens come last in every order.
    """
    code = codes[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    if order:
        code = np.where(code >= 96, code, np.uint64(0))  # counts from about 4000 on
    return (code << np.uint64(56)) | (mix(token + np.uint64(order)) >> np.uint64(8))


def hot_blocks(codes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each code of a sketch, into how many blocks its tokens are dealt.

    A bucket is shared by many tokens when there are far more of them than buckets. So
    only what stands out counts: above the median bucket twice over, and less that median.
    """
    count = 2 ** (np.arange(256) / 8) - 1
    floor = count[int(np.median(codes))]
    return np.where(count > max(block, 2 * floor), np.ceil((count - floor) / block), 1).astype(np.int64)


def postings(df: DataFrame, units: Units, codes: np.ndarray, threshold: Threshold, order: int = 0, only: np.ndarray | None = None, drop_single: bool = False, class_rows: bool = False, text: str = "text") -> DataFrame:
    """The prefix rows under one order of all classes (those that the bit map ``only`` may hold), each once per map task, and again where an earlier unit of it turns up.

    With ``class_rows``, also a row for each class itself.
    """
    sent = df.sparkSession.sparkContext.broadcast((codes, only))  # sizes are fixed by SKETCH_BITS and bitmap()
    blocks_of = hot_blocks(codes)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        codes, only = sent.value
        for batch in slices(batches, text, TEXT_CHARS):
            doc, line, offsets, plain = units(batch)
            sig, b0, b1 = signatures(offsets, plain)
            n = np.diff(offsets)
            new = n > 0
            if only is not None:
                new &= has(only, signed(sig))
            if len(seen) > SEEN:
                seen.clear()
            for i, key, at in zip(np.flatnonzero(new).tolist(), (sig ^ (b0 << np.uint64(1)))[new].tolist(), zip(doc[new].tolist(), line[new].tolist())):
                if at < seen.get(key, (np.inf,)):
                    seen[key] = at
                else:
                    new[i] = False
            u = np.repeat(np.arange(len(doc)), n)
            keep = new[u]
            offsets, ranked = distinct(u[keep], ordered_by(order, plain[keep], codes), len(doc))
            u = np.repeat(np.arange(len(doc)), np.diff(offsets))
            pos = np.arange(len(ranked)) - offsets[u]
            keep = pos < threshold.prefix(n)[u]
            if drop_single:  # a token that occurs once in all meets no other
                keep &= ranked >> np.uint64(56) > 8
            u, pos, ranked = u[keep], pos[keep], ranked[keep]
            code = ranked >> np.uint64(56)
            tail = np.full(len(u), order)
            blocks = blocks_of[code.astype(np.int64)]
            if len(code) and blocks.max() > 1:
                side = (mix(sig[u] + np.uint64(5)) % blocks.astype(np.uint64)).astype(np.int64)
                r = np.repeat(np.arange(len(u)), blocks)
                other = np.arange(len(r)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                u, pos, ranked, side, split = u[r], pos[r], ranked[r], side[r], blocks[r] > 1
                both = ((np.minimum(side, other) << 31) | np.maximum(side, other)).astype(np.uint64)
                ranked = np.where(split, mix(ranked ^ mix(both + np.uint64(1))), ranked)
                tail = order + np.where(side != other, IS_CROSS, 0) + np.where(side > other, IS_SECOND, 0)
            columns = [signed(ranked), (n[u] << 32) | pos, (line[u] << LINE_SHIFT) | tail, signed(sig[u]), signed(b0[u]), signed(b1[u]), doc[u]]
            if class_rows:
                own = np.flatnonzero(new)
                more = [signed(mix(sig[own])), n[own] << 32, (line[own] << LINE_SHIFT) | IS_CLASS, signed(sig[own]), signed(b0[own]), signed(b1[own]), doc[own]]
                columns = [np.concatenate(x) for x in zip(columns, more)]
            for lo in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 200_000]) for c in columns], names=list(POSTING))

    return df.mapInArrow(post, POSTING_SCHEMA)


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def groups(batches: Iterator[pa.RecordBatch], chunk: int, limit: int) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Rows sorted by token as columns, cut only between tokens.

    A token of more than ``limit`` rows comes in pieces that are marked True. Of a class's
    rows, which also have a token of their own, the earliest is kept instead.
    """
    held: list[dict[str, np.ndarray]] = []
    n, most, inside = 0, max(chunk, limit), None  # inside: the token whose pieces are under way
    for b in batches:
        if b.num_rows:
            held.append({k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names})
            n += b.num_rows
        while held and inside is not None:
            rest = joined(held)
            end = int(np.searchsorted(rest["token"], inside, side="right"))
            if end:
                yield True, {k: v[:end] for k, v in rest.items()}
            if end < len(rest["token"]):
                inside = None
                held, n = [{k: v[end:] for k, v in rest.items()}], n - end
            else:
                held, n = [], 0
        if n < chunk:
            continue
        rest = joined(held)
        end = int(np.searchsorted(rest["token"], rest["token"][-1]))
        if end:
            yield False, {k: v[:end] for k, v in rest.items()}
            rest, n = {k: v[end:] for k, v in rest.items()}, n - end
        if n > most:
            if (rest["tail"] & IS_CLASS).all():
                rest = first_units(rest)
                n = len(rest["token"])
            else:
                inside = rest["token"][0]
                yield True, rest
                held, n = [], 0
                continue
        held = [rest]
    if held:
        yield False, joined(held)
    held.clear()
    trim()


def first_units(rows: dict[str, np.ndarray], *group: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows of the same class (in the same group, where one is given for each row), the earliest unit's."""
    order = np.lexsort((rows["tail"], rows["doc"], rows["sig"], *group))
    kinds = [rows[k][order] for k in ("at", "b0", "b1")]
    new = changes(rows["sig"][order], *(g[order] for g in group))
    if (changes(*kinds) & ~new).any():  # sets that share a signature
        order = np.lexsort((rows["tail"], rows["doc"], rows["b1"], rows["b0"], rows["at"], rows["sig"], *group))
        new = changes(*(rows[k][order] for k in ("sig", "at", "b0", "b1")), *(g[order] for g in group))
    return {k: v[order[new]] for k, v in rows.items()}


def pair_indices(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within consecutive groups of these sizes, a bounded number at a time."""
    start = np.cumsum(size) - size
    row_end = np.repeat(start + size, size)
    count = row_end - np.arange(len(row_end)) - 1  # partners behind each row
    lo = 0
    total = np.cumsum(count)
    while lo < len(count):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        lo = hi


class Maps:
    """Parity maps of rows (bytes, of powers of two; None: no map)."""

    def __init__(self, column: np.ndarray):
        self.size = np.array([0 if x is None else len(x) for x in column], np.int64)
        self.place = np.zeros(len(column), np.int64)
        self.words: dict[int, np.ndarray] = {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            at = np.flatnonzero(self.size == size)
            self.place[at] = np.arange(len(at))
            self.words[size] = np.frombuffer(b"".join(column[at].tolist()), np.uint64).reshape(len(at), size // 8)

    def taken(self, at: np.ndarray, size: int) -> np.ndarray:
        """The rows' maps, folded to a size none of theirs is under."""
        out = np.zeros((len(at), size // 8), np.uint64)
        for own, words in self.words.items():
            k = np.flatnonzero(self.size[at] == own)
            if len(k):
                part = words[self.place[at[k]]]
                while part.shape[1] > size // 8:
                    half = part.shape[1] // 2
                    part = part[:, :half] ^ part[:, half:]
                out[k] = part
        return out

    def near(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs' maps differ in so many bits at most."""
        size = np.minimum(self.size[i], self.size[j])
        ok = np.ones(len(i), bool)
        for s in np.unique(size[size > 0]).tolist():
            k = np.flatnonzero(size == s)
            step = max(1, MAP_BYTES // s)
            for lo in range(0, len(k), step):
                p = k[lo : lo + step]
                ok[p] = np.bitwise_count(self.taken(i[p], s) ^ self.taken(j[p], s)).sum(axis=1) <= most[p]
        return ok


class Group:
    """Rows of one or many token groups, and the filters that candidates among them must pass."""

    def __init__(self, rows: dict[str, np.ndarray], threshold: Threshold):
        self.rows, self.t = rows, threshold
        self.n, self.pos = rows["at"] >> 32, rows["at"] & 0xFFFFFFFF
        self.line, self.side = rows["tail"] >> LINE_SHIFT, rows["tail"] & IS_SECOND
        self.b0, self.b1 = rows["b0"].view(np.uint64), rows["b1"].view(np.uint64)
        self.cross = (rows["tail"] & IS_CROSS) != 0
        self.label = rows.get("label")
        self.maps = Maps(rows["map"]) if "map" in rows else None

    def passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the index pairs that pass, as (earlier, later)."""
        r, n = self.rows, self.n
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = self.t.den * low >= self.t.num * high
        ok &= ~self.cross[i] | (self.side[i] != self.side[j])
        i, j = i[ok], j[ok]
        need = self.t.overlap(n[i], n[j])
        ok = np.minimum(n[i] - self.pos[i], n[j] - self.pos[j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        apart = np.bitwise_count(self.b0[i] ^ self.b0[j]).astype(np.int64) + np.bitwise_count(self.b1[i] ^ self.b1[j])
        ok = apart <= n[i] + n[j] - 2 * need
        i, j = i[ok], j[ok]
        ok = r["sig"][i] != r["sig"][j]
        if self.label is not None:
            ok &= self.label[i] != self.label[j]
        i, j = i[ok], j[ok]
        if self.maps is not None and len(i):
            ok = self.maps.near(i, j, n[i] + n[j] - 2 * self.t.overlap(n[i], n[j]))
            i, j = i[ok], j[ok]
        swap = (r["doc"][j] < r["doc"][i]) | ((r["doc"][j] == r["doc"][i]) & (self.line[j] < self.line[i]))
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        if self.label is not None:
            ok = self.label[b] != 0
            a, b = a[ok], b[ok]
        return a, b

    def small(self, size: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All passing pairs of consecutive small groups; ``at`` are their rows."""
        for i, j in pair_indices(size):
            yield self.passing(at[i], at[j])

    def large(self, at: np.ndarray, cap: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passing pairs of one group: with a cap, a row is done once that many earlier ones fit it."""
        order = at[np.lexsort((self.line[at], self.rows["doc"][at]))]
        if self.label is not None:  # two rows of different labels are not both of the most frequent one
            names, count = np.unique(self.label[order], return_counts=True)
            rest = self.label[order] != names[np.argmax(count)]
            order = np.concatenate([order[rest], order[~rest]])
            drivers = int(rest.sum())
        else:
            drivers = len(order)
        found = np.zeros(len(self.n), np.int64)
        step = max(1, min(64, PAIRS // len(order)))
        for lo in range(0, drivers, step):
            hi = min(drivers, lo + step)
            later = order[lo + 1 :]
            if cap is not None:
                later = later[found[later] < cap]
                if not len(later):
                    break
            rank = np.empty(len(self.n), np.int64)
            rank[order] = np.arange(len(order))
            i, j = np.repeat(order[lo:hi], len(later)), np.tile(later, hi - lo)
            ok = rank[j] > rank[i]
            a, b = self.passing(i[ok], j[ok])
            np.add.at(found, b, 1)
            yield a, b


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def several(g: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows of groups with more than one row, and the sizes of these groups."""
    start = np.flatnonzero(changes(g["token"]))
    size = np.diff(np.append(start, len(g["token"])))
    keep = np.repeat(size > 1, size)
    return {k: v[keep] for k, v in g.items()}, size[size > 1]


def found_rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    full = [np.full(n, kind), *columns, *[np.zeros(n, np.int64)] * (7 - len(columns))]
    for lo in range(0, n, 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 200_000].astype(np.int64, copy=False)) for c in full], names=list(FOUND))


def runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive groups with at most PAIRS pairs together, or one."""
    total = np.cumsum(size * (size - 1) // 2)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        yield lo, hi
        lo = hi


def candidates(posted: DataFrame, threshold: Threshold, cap: int | None) -> DataFrame:
    """PAIR rows (the earlier unit's class in sig, doc, line; the later one's in sig2 ...) that pass all filters.

    ``bits`` tells under which orders a pair was met; all bits where a cap may have hidden
    it from others. With a cap, also OPEN rows: those of groups where it cut something off,
    or of more than LIMIT rows, which make no pairs here. Those of them whose own candidates are all there are OPEN_WHOLE.
    Rows with a column ``label`` make no pairs of equal labels, nor pairs whose later class has
    label 0; parity maps in a column ``map`` are one more filter. Class rows come out once per class (CLASS), with the first unit.
    """
    chunk, limit = CHUNK_MAPS if "map" in posted.columns else CHUNK, LIMIT if cap is not None else 1 << 62

    def paired(g: dict[str, np.ndarray], size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Groups that may be paired together."""
        number = np.repeat(np.arange(len(size)), size)
        group = Group(g, threshold)
        begin = np.cumsum(size) - size
        if size[0] <= SMALL:
            parts = group.small(size, np.arange(len(number)))
        else:
            parts = group.large(np.arange(begin[0], begin[0] + size[0]), cap)
        order = g["tail"] & ORDER_MASK
        if cap is None:
            for a, b in parts:
                if len(a):
                    first = np.lexsort((order[b], g["sig"][b], g["sig"][a]))
                    a, b = a[first], b[first]
                    new = changes(g["sig"][a], g["sig"][b], order[b])
                    a, b = a[new], b[new]
                    yield from found_rows(PAIR, 1 << order[b], group.line[a], group.line[b], g["sig"][a], g["doc"][a], g["sig"][b], g["doc"][b])
            return
        a, b = (np.concatenate(x) for x in zip(*parts))
        short = np.zeros(len(number), bool)  # rows that may have more candidates than are given
        if len(a):
            by = np.lexsort((group.line[a], g["doc"][a], b))
            a, b = a[by], b[by]
            start = changes(b)
            rank = np.arange(len(b)) - np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))
            # a row that reached the cap may have more; a small group tells for sure
            short[b[rank >= cap]] = True
            short[b[(rank == cap - 1) & (size[number[b]] > SMALL)]] = True
            a, b = a[rank < cap], b[rank < cap]
        over = np.zeros(len(size), bool)
        over[number[short]] = True
        bits = np.where(over[number[b]], -1, 1 << order[b])
        yield from found_rows(PAIR, bits, group.line[a], group.line[b], g["sig"][a], g["doc"][a], g["sig"][b], g["doc"][b])
        for kind, r in ((OPEN, np.flatnonzero(short)), (OPEN_WHOLE, np.flatnonzero(over[number] & ~short))):
            yield from found_rows(kind, *(g[k][r] for k in POSTING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for too_large, g in groups(batches, chunk, limit):
            is_class = (g["tail"] & IS_CLASS) != 0
            if is_class.any():
                c = first_units({k: v[is_class] for k, v in g.items()})
                yield from found_rows(CLASS, c["sig"], c["doc"], c["tail"] >> LINE_SHIFT)
                g = {k: v[~is_class] for k, v in g.items()}
            if too_large:
                yield from found_rows(OPEN, *(g[k] for k in POSTING))
                continue
            if not len(g["token"]):
                continue
            g, size = several(g)
            if not len(size):
                continue
            # the same class from several map tasks: its earliest unit comes first, and stays
            g, size = several(first_units(g, np.repeat(np.arange(len(size)), size)))
            begin = np.append(np.cumsum(size) - size, size.sum())
            at = 0
            for large in [*np.flatnonzero(size > SMALL).tolist(), len(size)]:
                spans = [(at + lo, at + hi) for lo, hi in runs(size[at:large])]
                for lo, hi in [*spans, *[(large, large + 1)] * (large < len(size))]:
                    own = {k: v[begin[lo] : begin[hi]] for k, v in g.items()}
                    if size[lo] > limit:
                        yield from found_rows(OPEN, *(own[k] for k in POSTING))
                    else:
                        yield from paired(own, size[lo:hi])
                at = large + 1

    # one sort column, which Spark sorts by radix
    return posted.repartition("token").sortWithinPartitions("token").mapInArrow(run, FOUND_SCHEMA)


def reopened(rows: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Open rows (with ``label``) as the second round takes them.

    Groups of one label are done and go. The others are dealt to pairs of blocks by their exact
    counts. Classes of more than MAP_FROM tokens get parity maps, by ``sets`` from pairs of them.
    """
    size = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token", "rows")
    rows = cut(rows.join(size, "token"))
    blocks = F.ceil(F.col("rows") / OPEN_BLOCK)
    rows = rows.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("sig", F.lit(5)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    mark = F.when(F.col("side") != F.col("other"), IS_CROSS).otherwise(0) + F.when(F.col("side") > F.col("other"), IS_SECOND).otherwise(0)
    plain = F.col("tail").bitwiseAND(F.lit(~(IS_CROSS | IS_SECOND)))
    dealt = rows.withColumns({
        "token": F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("side", "other"), F.greatest("side", "other"))),
        "tail": F.when(F.col("blocks") == 1, F.col("tail")).otherwise(plain + mark),
    }).select(*POSTING, "label")
    long = rows.filter(F.shiftright("at", 32) > MAP_FROM).groupBy("sig").agg(F.min(F.struct("doc", F.shiftright("tail", LINE_SHIFT).alias("line"))).alias("x"))
    # each such class once, as a pair with itself
    long = cut(long.select("sig", "x.doc", "x.line", F.col("sig").alias("sig2"), F.col("x.doc").alias("doc2"), F.col("x.line").alias("line2")))
    maps = sets(long).select("sig", F.col("set").alias("map")) if not long.isEmpty() else None
    return dealt.withColumn("map", F.lit(None).cast("binary")) if maps is None else dealt.join(cut(maps), "sig", "left").select(*POSTING, "label", "map")


def of_kind(found: DataFrame, kind: int, names: tuple[str, ...]) -> DataFrame:
    return found.filter(F.col("kind") == kind).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def pairs_of(found: DataFrame) -> DataFrame:
    """Each pair of classes once, with the bits of its orders and the earliest units named."""
    pairs = of_kind(found, PAIR, PAIR_COLUMNS)
    return pairs.groupBy("sig", "sig2").agg(F.bit_or("bits").alias("bits"), F.min(F.struct("doc", "line")).alias("x"), F.min(F.struct("doc2", "line2")).alias("y")).select("sig", "sig2", "bits", "x.doc", "x.line", "y.doc2", "y.line2")


def open_rows(found: DataFrame) -> DataFrame:
    return of_kind(found, OPEN, POSTING).unionByName(whole_rows(found))


def short_rows(found: DataFrame) -> DataFrame:
    """The open rows that may have more earlier candidates in their group than the pairs tell."""
    return of_kind(found, OPEN, POSTING)


def whole_rows(found: DataFrame) -> DataFrame:
    return of_kind(found, OPEN_WHOLE, POSTING)


def bitmap(keys: DataFrame, bits: int | None = None, each: int = 16) -> np.ndarray:
    """A bit for each bucket that a key (column ``key``, evenly spread longs) falls into.

    About ``each`` bits for each key, from 2**20 on, 2**BITMAP_BITS at most: 16 MB. Beyond
    some ten million keys it lets more through, which the joins behind it keep out.
    """
    if bits is None:
        bits = min(BITMAP_BITS, max(20, (each * keys.count()).bit_length()))
    at = F.shiftrightunsigned("key", 64 - bits)
    words = keys.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at.bitwiseAND(F.lit(63))).cast("int")).alias("m"))
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys may be among those of the bit map."""
    at = key.view(np.uint64) >> np.uint64(64 - (len(bits).bit_length() - 1 + 6))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def classes_of(pairs: DataFrame) -> DataFrame:
    """sig, doc, line of each class in pairs, with its earliest unit named there."""
    later = pairs.select(F.col("sig2").alias("sig"), F.col("doc2").alias("doc"), F.col("line2").alias("line"))
    return pairs.select("sig", "doc", "line").unionByName(later).groupBy("sig").agg(F.min(F.struct("doc", "line")).alias("at")).select("sig", "at.doc", "at.line")


def fetch_sets(pairs: DataFrame, df: DataFrame, units: Units, maps: bool = False, text: str = "text", bits: int | None = None) -> DataFrame:
    """sig, n, set (binary, ascending uint64) of the classes in pairs; with ``maps``, their parity maps for sets, of so many bits at most.

    Sets are made again, from the texts of the documents that pairs name: bit maps of
    bounded size keep most other texts out, and an exact join the rest.
    """
    context = df.sparkSession.sparkContext
    named = cut(classes_of(pairs))
    ids = named.select("doc").distinct().limit(FEW_DOCUMENTS + 1)
    if ids.count() <= FEW_DOCUMENTS:  # a checked size
        df = df.join(F.broadcast(ids), F.col("doc_id") == F.col("doc"), "left_semi")
    wanted = context.broadcast(bitmap(named.select(F.col("sig").alias("key"))))
    docs = context.broadcast(bitmap(named.select(F.xxhash64("doc").alias("key"))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXT_CHARS):
            batch = batch.filter(pa.array(has(docs.value, batch.column("key").to_numpy())))
            if not batch.num_rows:
                continue
            doc, line, offsets, token = units(batch)
            sig, _, _ = signatures(offsets, token)
            pick = np.flatnonzero((np.diff(offsets) > 0) & has(wanted.value, signed(sig)))
            sets = [token[offsets[i] : offsets[i + 1]] for i in pick.tolist()]
            sets = [(parity_map(x, bits) if maps else x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig[pick])), pa.array(doc[pick]), pa.array(line[pick]), pa.array(np.diff(offsets)[pick]), pa.array(sets, pa.binary())], names=["sig", "doc", "line", "n", "set"])

    sets = df.withColumn("key", F.xxhash64(F.col("doc_id").cast("long"))).mapInArrow(fetch, "sig long, doc long, line long, n long, `set` binary")
    at = named.select("sig", F.col("doc").alias("d"), F.col("line").alias("l"))
    # of repeated rows of one document, one is enough
    return sets.join(at, "sig").filter("doc = d and line = l").groupBy("sig").agg(F.first("n").alias("n"), F.first("set").alias("set"))


def parity_map(token: np.ndarray, most: int | None = None) -> np.ndarray:
    """A bit for each residue, flipped by each token of it; as many bits as the next power of two from the set's size, 256 at least."""
    bits = max(256, 1 << (len(token) - 1).bit_length())
    bits = min(bits, most or bits)
    flips = np.bincount((mix(token + np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool), bitorder="little")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many tokens are in one set only. A longer map is folded to the other's length, which keeps its residues."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sift(pairs: DataFrame, maps: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of the pairs that may have the similarity by their parity maps, a fiftieth of their sets' size."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n1").to_numpy(), b.column("n2").to_numpy()
            most = n + m - 2 * threshold.overlap(n, m)
            good = [apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= d for x, y, d in zip(b.column("m1"), b.column("m2"), most.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good, pa.bool_())) for c in ("sig", "sig2")], names=["sig", "sig2"])

    left = pairs.select("sig", "sig2").join(maps.select("sig", F.col("n").alias("n1"), F.col("set").alias("m1")), "sig")
    both = left.join(maps.select(F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("set").alias("m2")), "sig2")
    return both.select("sig", "sig2", "n1", "m1", "n2", "m2").mapInArrow(check, "sig long, sig2 long")


def verify(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """sig, sig2 of those pairs whose sets have the similarity."""
    left = pairs.select("sig", "sig2").join(sets.select("sig", F.col("set").alias("s1")), "sig")
    both = left.join(sets.select(F.col("sig").alias("sig2"), F.col("set").alias("s2")), "sig2")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("s1"), b.column("s2"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good[i] = threshold.holds(common, len(x), len(y))
            yield pa.RecordBatch.from_arrays([b.column("sig").filter(pa.array(good)), b.column("sig2").filter(pa.array(good))], names=["sig", "sig2"])

    return both.select("sig", "sig2", "s1", "s2").mapInArrow(check, "sig long, sig2 long")


def earliest(pairs: DataFrame) -> DataFrame:
    """Of each later class, its pair with the earliest one."""
    best = pairs.groupBy("sig2").agg(F.min(F.struct("doc", "line", "sig")).alias("p"))
    return best.select("p.sig", "sig2")
