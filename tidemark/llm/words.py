"""Words, lines and shingles of whole batches of texts, as 64-bit hashes in NumPy.

Words lie between ASCII white space; A-Z count as a-z. A word's hash takes its bytes
eight at a time, for all words of a batch together; very long words are hashed
alone. Words are compared by their hashes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import mix

#: Bytes from which on a word is hashed alone.
LONG_WORD = 512


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start on, A-Z as a-z."""
    lower = np.zeros(len(data) + 8, np.uint8)
    lower[:-8] = data + (((data - np.uint8(65)) < 26).view(np.uint8) << 5)  # A-Z only
    eight = np.ndarray((len(data) + 1,), "<u8", lower, 0, (1,))  # at each place, the eight bytes from there on
    multiplier, every = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFFFFFFFFFF)

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] & (every >> ((8 - np.minimum(left, 8)) << 3).astype(np.uint64))

    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * multiplier + part(start, size))
        rows = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at, left = start[rows] + 8, size[rows] - 8
        while len(rows):
            h[rows] = mix(h[rows] * multiplier + part(at, left))
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] ^= np.uint64(int.from_bytes(blake2b(lower[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


class Texts:
    """Words of texts: ``hash`` of each, ``begin`` (its first byte), ``offsets`` (words by text)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = (int(self.edges[0]), int(self.edges[-1])) if len(texts) else (0, 0)
        self.edges = self.edges - lo if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        n = len(self.data)
        inside = np.ones(n + 1, bool)
        inside[:n] = (self.data != 32) & ((self.data - np.uint8(9)) > 4)
        inside[n] = False
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        cut = np.zeros(n + 1, bool)
        cut[self.edges] = True
        start = np.flatnonzero(inside & (~before | cut))
        end = np.flatnonzero(before & (~inside | cut))
        self.hash = hash_spans(self.data, start, end - start)
        self.begin = start
        self.offsets = np.searchsorted(start, self.edges)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines between line feeds: (text of each, number in it from 0, word offsets by line)."""
        breaks = np.flatnonzero(self.data == 10) + 1
        own = np.searchsorted(self.edges, breaks - 1, side="right") - 1
        n = len(self.edges) - 1
        text = np.concatenate([np.arange(n), own])
        at = np.concatenate([self.edges[:-1], breaks])
        order = np.lexsort((at, text, np.concatenate([np.zeros(n), np.ones(len(own))])))
        order = order[np.argsort(text[order], kind="stable")]
        text, at = text[order], at[order]
        first = np.searchsorted(text, np.arange(n))
        return text, np.arange(len(text)) - first[text], np.append(np.searchsorted(self.begin, at), len(self.begin))


def shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all k-word shingles; a text of 1 to k-1 words has one, of all its words."""
    h, offsets = texts.hash, texts.offsets
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return row, h
    left = offsets[row + 1] - np.arange(len(h))  # words from here to the end
    acc = h.copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            step = acc[: len(h) - i] if i < len(h) else acc[:0]
            mixed = (step * np.uint64(0xD6E8FEB86659FD93)) ^ (step >> np.uint64(32))
            has = left[: len(step)] > i
            acc[: len(step)] = np.where(has, mixed + h[i : i + len(step)], step)
        acc = mix(acc)
    keep = (left >= k) | ((n[row] < k) & (left == n[row]))
    return row[keep], acc[keep]


def distinct(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct tokens in ascending order: (offsets by row, tokens)."""
    if rows <= 1 << 24:
        # one key of the row and the token's first 40 bits; the few runs that it leaves tied are put in order by themselves
        key = (row.astype(np.uint64) << np.uint64(40)) | (token >> np.uint64(24))
        order = np.argsort(key)
        row, token, key = row[order], token[order], key[order]
        tied = (key[1:] == key[:-1]) & (token[1:] != token[:-1])
        if tied.any():
            loose = np.isin(key, key[1:][tied])
            own = np.flatnonzero(loose)
            token[own] = token[own][np.lexsort((token[own], key[own]))]
    else:
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    row, token = row[keep], token[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64), token


def signatures(offsets: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row's set: a 64-bit hash of the set, and two 64-bit parity maps.

    Each token flips one bit in a map, so the maps of two sets differ in at most
    as many bits as the sets differ in tokens.
    """
    n = np.diff(offsets)
    full = np.flatnonzero(n > 0)
    sig, a, b = (np.zeros(len(n), np.uint64) for _ in range(3))
    if len(full):
        at = offsets[full]
        one = np.uint64(1)
        spread = mix(token)
        with np.errstate(over="ignore"):
            sig[full] = mix(np.add.reduceat(spread, at) + n[full].astype(np.uint64))
        bit = one << (spread & np.uint64(63))
        first = (spread >> np.uint64(6)) & one == 0
        zero = np.uint64(0)
        a[full] = np.bitwise_xor.reduceat(np.where(first, bit, zero), at)
        b[full] = np.bitwise_xor.reduceat(np.where(first, zero, bit), at)
    return sig, a, b
