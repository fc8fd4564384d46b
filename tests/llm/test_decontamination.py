import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents
from tidemark.llm import decontamination as D


def words(rng, n, prefix="w"):
    return [f"{prefix}{rng.randint(0, 5000)}" for _ in range(n)]


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def planted(seed):
    """(items, texts, wanted pairs): whole items, with words exchanged, other case and marks, and clean texts."""
    rng = random.Random(seed)
    items = [words(rng, rng.randint(14, 60), "q") for _ in range(30)]
    texts, want = [], set()
    for i in range(120):
        t = words(rng, rng.randint(0, 200))
        if i % 3 == 0:
            k = rng.randrange(len(items))
            part = list(items[k])
            for j in range(rng.randint(0, 2), len(part), rng.randint(9, 12)):
                part[j] = "other"
            part = [w.upper() + rng.choice(["", ",", "."]) for w in part]
            at = rng.randint(0, len(t))
            t[at:at] = part
            want.add((i, k))
        texts.append(" ".join(t))
    return [" ".join(i) for i in items], texts, want


def test_planted(spark):
    items, texts, want = planted(1)
    rows = D.overlaps(documents(spark, texts), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert r["doc_end"] - r["doc_start"] == r["item_end"] - r["item_start"] >= r["matches"] >= 12
    sliced = D.overlaps(documents(spark, texts), bench(spark, items), slice_chars=900).collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, rows))


def test_large_benchmark_is_joined(spark, monkeypatch):
    """The join of seeds gives what the index in memory does: odd rows, repeated ones, a phrase that many items and texts hold."""
    items, texts, _ = planted(4)
    phrase = " ".join(f"common{i}" for i in range(9))
    items = [f"{phrase} {t}" for t in items[:10]] + ["eight words are the least that any item", "", None, items[0]]
    texts = texts[:30] + [phrase, f"{phrase} {phrase}", "", None, (items[3],), (items[3],), "x " * 20000 + items[4], "Eight words, are the least that other item"]
    docs = documents(spark, texts).unionByName(documents(spark, [items[5], "clean text"])).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "shift")
    b = bench(spark, items).unionByName(bench(spark, items[:2]))
    want = sorted(tuple(-1 if x is None else x for x in r) for r in D.overlaps(docs, b).collect())
    assert len(want) >= 8 and any(r[0] == -1 for r in want)
    monkeypatch.setattr(D, "HITS", 5)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in D.overlaps(docs, b).collect()) == want
    assert sorted(tuple(-1 if x is None else x for x in r) for r in D.overlaps(docs, b, slice_chars=0).collect()) == want
    left = [sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in D.remove(docs, b, slice_chars=n).collect()) for n in (0, 10**9)]
    assert left[0] == left[1] and D.remove(docs, b).columns == docs.columns
    # of two rows of doc_id 1 the clean one stays
    assert [t for n, i, t in left[0] if not n and i == 1 and t == "clean text"] == ["clean text"]
    assert D.overlaps(docs.limit(0), b, slice_chars=0).count() == 0


def brute(items, texts):
    """All alignments of all pairs."""
    split = lambda t: [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (t or "").split()) if w]
    out = set()
    for i, t in enumerate(texts):
        own = split(t)
        for k, item in enumerate(items):
            q = split(item)
            if len(q) < D.MIN_ITEM:
                continue
            for d in range(1 - len(q), len(own)):
                lo, hi = max(0, d), min(len(own), d + len(q))
                total = [0]
                for x in range(lo, hi):
                    total.append(total[-1] + (1 if own[x] == q[x - d] else -1))
                ends = [(total[e] - min(total[: e + 1]), -e) for e in range(len(total))]
                score, e = max(ends)
                s = max(x for x in range(-e + 1) if total[x] == total[-e] - score)
                same = (score + (-e - s)) // 2
                if same >= min(D.MIN_MATCHES, D.SHARE * len(q)) and same >= D.SHARE * (-e - s) and e:
                    out.add((i, k))
    return out


def test_against_all_alignments(spark):
    items, texts, _ = planted(2)
    items, texts = items[:12] + ["too short an item", "", None, "eight words are the least that any item"], texts[:40] + ["eight WORDS are the least, that any item!", "eight words are the least"]
    texts[5] = " ".join(items[0].split()[:9])  # under the least overlap
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(documents(spark, texts), bench(spark, items)).collect()}
    assert got == brute(items, texts)


def test_odd_rows(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = documents(spark, [item, "", None, (item,), "clean", "x " * 40000 + item, item])
    b = bench(spark, [item, item])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"]) for r in D.overlaps(docs, b).collect()) == [(False, 0, 0), (False, 0, 1), (False, 5, 0), (False, 5, 1), (False, 6, 0), (False, 6, 1), (True, 0, 0), (True, 0, 1)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in D.remove(docs, b).collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    assert D.overlaps(docs.limit(0), b).count() == 0 and D.overlaps(docs, b.limit(0)).count() == 0
    assert D.remove(docs, b.limit(0)).count() == 7


def exchanged(n):
    """All sets of places of an item of n words of which SHARE lets others be exchanged."""
    most = n - math.ceil(D.SHARE * n)
    return [p for k in range(most + 1) for p in itertools.combinations(range(n), k)]


@pytest.mark.parametrize("n", range(14, 25))
def test_masks_meet_all_patterns(n):
    p = np.array([sum(1 << i for i in x) for x in exchanged(n)])
    met = np.zeros(len(p), bool)
    for m in D.MASKS:
        for at in range(n - len(m) + 1):
            met |= p & (int(m[::-1], 2) << at) == 0
    assert met.all()


def found(n, patterns):
    item = [f"q{i}" for i in range(n)]
    texts = ["a b " + " ".join(f"x{i}" if i in p else w for i, w in enumerate(item)) + " c" for p in map(set, patterns)]
    return {r for r, *_ in D.Index([7], [" ".join(item)]).overlaps(pa.array(texts), D.MIN_MATCHES, D.SHARE)}


@pytest.mark.parametrize("n", range(8, 18))
def test_all_patterns_are_found(n):
    patterns, want = exchanged(n), set()
    for k, p in enumerate(patterns):
        equal = np.array([i not in p for i in range(n)])
        start, end = D.best_segment(equal)
        same = equal[start:end].sum()
        if same >= min(D.MIN_MATCHES, D.SHARE * n) and same >= D.SHARE * (end - start):
            want.add(k)
    assert want and found(n, patterns) == want


def test_every_fourth_word_exchanged():
    for n in range(20, 101, 8):
        assert found(n, [range(phase, n, 4) for phase in range(4)]) == {0, 1, 2, 3}
