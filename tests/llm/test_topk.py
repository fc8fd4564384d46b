import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


def expected(rows, k, scale, is_query):
    v = {i: [math.floor(scale * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if is_query(q):
            s = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def data(seed, n=600, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(i, (centres[i % 6] * rng.lognormal() + 0.1 * rng.normal(size=d)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(60)]  # a very common vector


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed, monkeypatch):
    rows = data(seed) + [(5000, None), (5020, [float("nan")] * 8), (5040, [None] * 8), (5060, [float("inf")] * 8), (5080, [1.0, 2.0]), (5100, [2.0, 1.0]), (5120, []), (None, [1.0] * 8), (5140, [0.0] * 8)]
    if seed == 2:  # many stripes and blocks, and short buckets
        monkeypatch.setattr(topk, "STRIPE", 100)
        monkeypatch.setattr(topk, "BLOCK", 10)
        monkeypatch.setattr(topk, "BUCKET", 16)
        monkeypatch.setattr(topk, "SEED_BYTES", 64 * 30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == expected(rows, 5, 64, lambda i: i % 20 == 0)


def test_repeated_ids_and_clashing_names(spark):
    """Each row is a candidate for all others, also for rows of its own id; names of other columns don't matter."""
    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (6, [5.0, 5.0]), (6, [5.0, 5.0]), (13, [4.0, 4.0]), (20, [0.0, -1.0])]
    df = spark.createDataFrame([(i, e, "x", 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, row string, v int, norm double")
    got = sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0, k=3).collect())
    v = [[math.floor(64 * x) for x in e] for _, e in rows]
    want = []
    for a, (q, _) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v[a], v[b])), i) for b, (i, _) in enumerate(rows) if b != a)[:3]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want) and len(got) == 9


def test_short_candidates_are_not_moved(spark, monkeypatch):
    """Lengths that vary: bands that no query needs stay where they are, and the answer is whole."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 6))
    x = x / np.linalg.norm(x, axis=1)[:, None] * np.where(np.arange(800) % 10 == 0, 40, 0.5)[:, None]
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    monkeypatch.setattr(topk, "STRIPE", 40)
    monkeypatch.setattr(topk, "BLOCK", 15)
    monkeypatch.setattr(topk, "BANDS", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, lambda i: i % 20 == 0, k=5)
    assert {tuple(r) for r in got.collect()} == expected(rows, 5, 64, lambda i: i % 20 == 0)
    v = topk.quantise(df, "vec_id", "embedding", 64.0)
    seeds = topk.matrices(v.orderBy(F.desc("norm")).limit(200).select("vec_id", "row", "v").toArrow())
    need = topk.thresholds(v.filter("vec_id % 20 = 0"), seeds, 5).select((F.col("theta") / F.col("norm")).alias("n")).collect()
    taken = [sum(np.linalg.norm(np.floor(64 * x), axis=1) >= r["n"]) for r in need]
    assert np.mean(taken) < 200


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in expected(rows, 4, 64, lambda i: i % 20 == 0)}
    assert {tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0, k=4).collect()} == want


def test_coordinate_pruning_keeps_all():
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    c = np.round(64 * (base + 0.05 * rng.normal(size=(500, 16)))).astype(np.int64)
    q = np.round(64 * (base + 0.05 * rng.normal(size=(7, 16)))).astype(np.int64)
    a, b, s = topk.search(np.arange(1000, 1007), q, np.full(7, -np.inf), np.arange(500), c, 10)
    scores = q @ c.T
    for i in range(7):
        want = sorted((-x, j) for j, x in enumerate(scores[i].tolist()))[:10]
        assert sorted((-x, j) for k, j, x in zip(a, b, s) if k == 1000 + i) == want
