import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents
from tidemark.llm import packing

TEXTS = ["", None, "a", "Hello, World! don't <|endoftext|> <|ENDOFTEXT|> x<|endoftext|>y", "É İstanbul ǅ ﬁ ΣΑΣ. naïve?!", "12 34ab\x1cq\x0bz \u00a0x\u2003y", "word " * 9000, "a " * 4095, "a " * 4096, "漢字かな交じり文 👍🏽 e\u0301", "a"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


def test_tokens(tokenizer):
    own = packing.WordTokenizer(packing.tokenizer_file())
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab.,'é <|>12\n\tÄß") for _ in range(80)) for _ in range(300)]
    offsets, ids = own.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_tokens_in_bounded_memory(monkeypatch):
    own = packing.WordTokenizer(packing.tokenizer_file())
    rng = random.Random(4)
    known = [f"{''.join(rng.choice('abcdefgh') for _ in range(5))}{rng.choice(['', '', ',', '.'])}" for _ in range(500)]
    texts = pa.array([*TEXTS, *(" ".join(rng.choice(known) for _ in range(2_000)) for _ in range(250))], pa.string())
    own.encode(texts)  # words are known from here on
    tracemalloc.start()
    try:
        offsets, ids = own.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]  # of Python and NumPy
    finally:
        tracemalloc.stop()
    assert peak < ids.nbytes + 50 * 500_000  # bytes beside the ids, for each word
    monkeypatch.setattr(packing, "STEP_WORDS", 997)
    again = own.encode(texts)
    assert (again[0] == offsets).all() and (again[1] == ids).all()


def check(rows, texts, tokenizer, size):
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        for k, r in enumerate(pieces):
            part = ids[doc][k * size : (k + 1) * size]
            assert (r["piece"], r["start"], r["length"]) == (k, k * size, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert len(pieces) == -(-len(ids[doc]) // size)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence), -(-sum(map(len, ids.values())) // size)


def test_pack(spark, tokenizer):
    rng = random.Random(5)
    texts = TEXTS + ["x " * rng.randint(1, 2500) for _ in range(60)]
    rows = packing.pack_documents(documents(spark, texts)).collect()
    used, least = check(rows, texts, tokenizer, 4096)
    assert used <= least + 1
    few = packing.pack_documents(documents(spark, texts), max_tokens=700, group_pieces=40).collect()
    check(few, texts, tokenizer, 700)
    packed = packing.pack_documents(documents(spark, texts), with_ids=True)
    whole = packing.sequences(packed).collect()
    assert sum(len(r["input_ids"]) for r in whole) == sum(r["length"] for r in rows)
    assert all(r["starts"][0] == 0 and len(r["doc_ids"]) == len(r["starts"]) for r in whole)
    assert packing.pack_documents(documents(spark, texts).limit(0)).count() == 0


def test_equal_ids_share_no_group(spark, tokenizer):
    """Repeated rows, null ids and clashing names: rows of one id are dealt to groups like all others."""
    docs = spark.createDataFrame([(None if i % 2 else 7, "x " * (i % 3 * 40 + 1), i, "y") for i in range(120)], "doc_id long, text string, piece int, grp string")
    rows = packing.pack_documents(docs, max_tokens=64, group_pieces=30).collect()
    assert len({r["sequence_id"] >> 32 for r in rows if r["length"] < 64}) >= 4
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == sorted((0 if i % 2 else 7, n) for i in range(120) for n in ([64] * ((i % 3 * 40 + 2) // 64) + [(i % 3 * 40 + 2) % 64] * ((i % 3 * 40 + 2) % 64 > 0)))
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 64


def test_pair_sums():
    n = [3, 3, 5, 8, 5, 1]
    got = packing.pair_sums(n, list(range(6)), 12)
    want = {n[i] + n[j] for i in range(6) for j in range(i) if n[i] + n[j] <= 12}
    assert got.keys() == want and all(i != j and n[i] + n[j] == s for s, (i, j) in got.items())
    many = np.array([40] * 2 + [1] * 100)
    bins = packing.local_search(many, [[0], [1], list(range(2, 102))], 100)
    assert len(bins) == 2


def test_local_search():
    lengths = np.array([6, 6, 4, 4, 3, 3, 2, 2])
    bins = packing.local_search(lengths, [[0, 4], [1, 5], [2, 6, 7], [3]], 10)
    assert sorted(i for b in bins for i in b) == list(range(8))
    assert len(bins) == 3 and all(sum(lengths[b]) <= 10 for b in bins)


def test_every_bin_may_give():
    """More bins than any fixed number are less full and can give nothing; the one that can is found."""
    lengths = np.array([81] * 600 + [18, 18, 17, 17, 16] + [83, 9])
    bins = packing.local_search(lengths, [*([i] for i in range(600)), list(range(600, 605)), [605, 606]], 100)
    assert sorted(i for b in bins for i in b) == list(range(607)) and all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) == 601


def gains(lengths, donor, taker, capacity):
    """By all pairs of items: the donor can give one or two for none or one, to a taker at least as full."""
    fill, space = lengths[donor].sum(), capacity - lengths[taker].sum()
    own = [lengths[i] for i in donor]
    sums = own + [a + b for k, a in enumerate(own) for b in own[:k]]
    return capacity - space >= fill and any(0 < x - j <= space for x in sums for j in [0, *lengths[taker]])


def test_search_ends_where_no_bin_can_give():
    rng = np.random.default_rng(3)
    for capacity, low, high in [(40, 2, 20), (41, 8, 19), (60, 12, 30), (60, 21, 59), (30, 10, 11)] * 6:
        lengths = rng.integers(low, high + 1, 60)
        bins = packing.best_fit(lengths, capacity) if low != 21 else [[i] for i in range(60)]
        able = {b for b, x in enumerate(bins) if any(gains(lengths, x, y, capacity) for y in bins if y is not x)}
        space = [capacity - int(lengths[b].sum()) for b in bins]
        order = sorted((s, b) for b, s in enumerate(space) if s)
        n = lengths.tolist()
        found = packing.givers(order, {b: packing.offer(n, x) for b, x in enumerate(bins)}, {b: packing.want(n, x, space[b]) for b, x in enumerate(bins)})
        assert len(found) == len(set(found)) and set(found) == able
        after = packing.local_search(lengths, [list(b) for b in bins], capacity)
        assert sorted(i for b in after for i in b) == list(range(60)) and all(lengths[b].sum() <= capacity for b in after)
        assert len(after) <= len(bins)
        assert len(after) == packing.least_bins(lengths, capacity) or not any(gains(lengths, x, y, capacity) for x in after for y in after if y is not x)


def fewest(lengths, capacity):
    """By all assignments."""
    best = len(lengths)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for x, s in enumerate(free):
            if s >= lengths[k]:
                go(k + 1, [*free[:x], s - lengths[k], *free[x + 1 :]])
        go(k + 1, [*free, capacity - lengths[k]])

    go(0, [])
    return best


def test_least_bins():
    rng = np.random.default_rng(4)
    met = 0
    for k in range(120):
        capacity = int(rng.integers(8, 16))
        lengths = rng.integers(1 + k % 5, capacity + 1, 7)
        bound, best = packing.least_bins(lengths, capacity), fewest(lengths.tolist(), capacity)
        assert -(-lengths.sum() // capacity) <= bound <= best
        met += bound == best
    assert met > 60
