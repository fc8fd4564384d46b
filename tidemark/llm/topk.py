"""Exact top-k inner-product search by norm-bucketed retrieval.

Starting thresholds come from the longest vectors of the table, a block of
bounded size that each query is compared with first; they are lower bounds of
the k-th best score, so nothing is lost. A threshold and a query's length tell how long a
candidate must be at least. Candidates are banded by length, queries by the shortest band that they
need, and only those bands are copied to a query's blocks: shorter ones are dropped before any row is moved.
Bands are dealt into stripes and queries into blocks of bounded size; each
(block, stripe) pair is one group. A group sorts its candidates by length and
walks through buckets of similar length, longest first. The query's running
k-th best score gives each bucket a local cosine threshold: above 1 the bucket
and all shorter ones are skipped; a high one prunes by coordinate (a unit vector
that close to the query must lie in an interval in the query's largest
coordinates); a low one prunes by length alone. What is left is verified by
products in integers.

Results for odd input: vectors that are null or hold a null or non-finite
component take no part. Scores are between vectors of equal dimension only.
Ties go to the smaller id. A query's own row is left out; other rows of the same id are
candidates like all others, and a query row that repeats an id has its own k best, under that id
again. Rows whose id is null take no part. Components beyond the range of long are held to that range,
scores likewise. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tables

STRIPE = 16_384
BLOCK = 2_048
BUCKET = 1_024
#: Bands of length, at most.
BANDS = 128
#: Bytes of long vectors that starting thresholds are taken from.
SEED_BYTES = 2_000_000
#: Local cosine from which on coordinates prune better than length.
COORDINATE_FROM = 0.75
LONG = (-(2**63), 2**63 - 1)


def quantise(df: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id, row (a number of its own), v (array of long), norm (double) of the rows that take part."""
    e = F.col(f"`{embedding}`")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    # a row's place in the scan tells it from others of its id; the same wherever the scan runs again
    df = df.select(f"`{vec_id}`", f"`{embedding}`").withColumn("__row", F.monotonically_increasing_id())
    out = df.filter(e.isNotNull() & whole & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col("__row").alias("row"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: ids, row numbers and vectors (float64, or Python integers where products could pass 2**53)."""
    ids, number = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    v = table.column("v").combine_chunks()
    if isinstance(v, pa.ChunkedArray):
        v = v.chunk(0) if v.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets, flat = v.offsets.to_numpy(), v.values.to_numpy()
    size, out = np.diff(offsets), {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = ids[rows], number[rows], flat[offsets[rows][:, None] + np.arange(d)[None, :]].reshape(len(rows), int(d))
    return out


def exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if top < 2**53 else object
    return q.astype(kind), c.astype(kind)


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    if scores.dtype == object:
        return np.sort(scores, axis=1)[:, -k].astype(np.float64) * (1 - 1e-12) - 1
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


def search(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, c_rows: np.ndarray | None = None) -> tuple[list, list, list]:
    """Rows (query, candidate, score) that hold each query's k best of these candidates, none under theta.

    A query's own row is the one whose number in ``c_rows`` is its id here; without, whose id is.
    """
    c_rows = c_ids if c_rows is None else c_rows
    q, c = exact(q, c)
    unit_q, unit_c = q.astype(np.float64), c.astype(np.float64)
    norm_q, norm_c = np.sqrt((unit_q**2).sum(1)), np.sqrt((unit_c**2).sum(1))
    order = np.lexsort((c_ids, -norm_c))
    c_ids, c_rows, c, norm_c, unit_c = c_ids[order], c_rows[order], c[order], norm_c[order], unit_c[order]
    unit_q = unit_q / np.maximum(norm_q, 1e-300)[:, None]
    unit_c = unit_c / np.maximum(norm_c, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :3] if q.shape[1] else np.zeros((len(q), 0), np.int64)
    theta = theta.astype(np.float64).copy()
    best: list[list[tuple]] = [[] for _ in q_ids]
    lo = 0
    while lo < len(c_ids):
        # a bucket: vectors down to nine tenths of its longest, BUCKET at most
        hi = min(lo + BUCKET, max(lo + 1, int(np.searchsorted(-norm_c, -0.9 * norm_c[lo], side="right"))))
        longest = norm_c[lo]
        with np.errstate(invalid="ignore", divide="ignore"):
            local = np.where(theta <= 0, -1.0, theta / np.maximum(norm_q * longest, 1e-300))
        active = np.flatnonzero(local <= 1 + 1e-9)
        if not len(active):
            break
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        by_length, by_coordinate = active[local[active] < COORDINATE_FROM], active[local[active] >= COORDINATE_FROM]
        if len(by_length):
            scores = q[by_length] @ c[lo:hi].T
            good = (scores >= theta[by_length][:, None]) & (c_rows[None, lo:hi] != q_ids[by_length][:, None])
            for i in np.flatnonzero(good.any(axis=1)):
                at = np.flatnonzero(good[i])
                found.append((by_length[i], lo + at, scores[i, at]))
        for i in by_coordinate:
            t = min(1.0, local[i]) - 1e-9
            # shorter vectors of the bucket need a cosine above t as well
            keep = np.ones(hi - lo, bool)
            for f in focus[i]:
                x = unit_q[i, f]
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                low = -1.0 if x < -t else x * t - spread
                high = 1.0 if x > t else x * t + spread
                keep &= (unit_c[lo:hi, f] >= low) & (unit_c[lo:hi, f] <= high)
            at = lo + np.flatnonzero(keep & (c_rows[lo:hi] != q_ids[i]))
            if len(at):
                scores = c[at] @ q[i]
                good = scores >= theta[i]
                if good.any():
                    found.append((i, at[good], scores[good]))
        for i, at, scores in found:
            if len(at) > k:  # all that reach the k-th best of these, ties included
                cutoff = kth(scores[None, :], k)[0]
                at, scores = at[scores >= cutoff], scores[scores >= cutoff]
            best[i] = sorted([*best[i], *((-int(s), int(c_ids[j])) for s, j in zip(scores, at))])[:k]
            if len(best[i]) == k:
                theta[i] = max(theta[i], float(-best[i][-1][0]) * (1 if q.dtype != object else 1 - 1e-12) - (q.dtype == object))
        lo = hi
    rows = [(int(q_ids[i]), j, s) for i, b in enumerate(best) for s, j in b]
    return [r[0] for r in rows], [r[1] for r in rows], [max(LONG[0], min(LONG[1], -r[2])) for r in rows]


def thresholds(queries: DataFrame, seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Queries with ``theta``: the k-th best score among the seeds, minus infinity where there are too few."""
    sent = queries.sparkSession.sparkContext.broadcast(seeds)  # SEED_BYTES, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            theta = dict.fromkeys(b.column("row").to_pylist(), -np.inf)
            for d, (_, rows, vectors) in matrices(table).items():
                if d not in sent.value:
                    continue
                _, s_rows, s = sent.value[d]
                for lo in range(0, len(rows), BLOCK):
                    x, y = exact(vectors[lo : lo + BLOCK], s)
                    scores, own = x @ y.T, rows[lo : lo + BLOCK, None] == s_rows[None, :]
                    if scores.size and (~own).sum(axis=1).min() >= k:
                        theta.update(zip(rows[lo : lo + BLOCK].tolist(), kth(np.where(own, scores.min() - 1, scores), k).tolist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(theta[r]) for r in b.column("row").to_pylist()], pa.float64())], names=[*b.schema.names, "theta"])

    return queries.mapInArrow(run, "vec_id long, row long, v array<long>, norm double, theta double")


def top_k(df: DataFrame, is_query, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row that ``is_query`` (a function of the id column) marks."""
    v = quantise(df, vec_id, embedding, scale)
    marked = v.filter(is_query(F.col("vec_id")))
    probes = [i / BANDS for i in range(1, BANDS)]
    size = v.agg(F.max(F.size("v")).alias("d"), F.percentile_approx("norm", probes, 10_000).alias("q")).first()
    edges = sorted(set(size["q"] or []))
    bounds = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
    band = lambda x: F.size(F.filter(bounds, lambda e: e <= x))  # noqa: E731  # of so many edges at or under it
    seeds = matrices(v.orderBy(F.desc("norm"), "vec_id", "row").limit(max(k + 1, SEED_BYTES // (8 * max(1, size["d"] or 1)))).select("vec_id", "row", "v").toArrow())
    asked = cut(thresholds(marked, seeds, k))
    # a candidate of a smaller norm can't reach the threshold; rounding is on the safe side
    need = F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.col("theta") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    asked = asked.withColumn("band", band(need))
    count = lambda df: {r["band"]: r["count"] for r in df.groupBy("band").count().collect()}  # noqa: E731  # BANDS rows at most
    have, wanted = count(v.select(band(F.col("norm")).alias("band"))), count(asked)
    stripes = [max(1, -(-have.get(i, 0) // STRIPE)) for i in range(len(edges) + 1)]
    blocks = [-(-wanted.get(i, 0) // BLOCK) for i in range(len(edges) + 1)]
    first_stripe, first_block = np.concatenate([[0], np.cumsum(stripes)]).tolist(), np.concatenate([[0], np.cumsum(blocks)]).tolist()
    table = lambda xs: F.array(*(F.lit(int(x)).cast("long") for x in xs))
    own = lambda first, n: F.get(table(first), F.col("band")) + F.pmod(F.xxhash64("row"), F.greatest(F.get(table(n), F.col("band")), F.lit(1)))
    # a band goes to the blocks that need it or shorter ones; a block to the stripes from the band on that it needs
    upto = F.get(table(first_block[1:]), F.col("band"))
    c = v.withColumn("band", band(F.col("norm"))).select("vec_id", "row", "v", own(first_stripe, stripes).alias("stripe"), F.explode(F.filter(F.sequence(F.lit(0).cast("long"), upto), lambda x: x < upto)).alias("block"))
    q = asked.select("vec_id", "row", "v", "theta", own(first_block, blocks).alias("block"), F.explode(F.sequence(F.get(table(first_stripe), F.col("band")), F.lit(first_stripe[-1] - 1).cast("long"))).alias("stripe"))

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            found = matrices(right)
            start = dict(zip(left.column("row").to_pylist(), left.column("theta").to_pylist()))
            for d, (q_ids, q_rows, vectors) in matrices(left).items():
                if d not in found:
                    continue
                c_ids, c_rows, c = found[d]
                rows, hits, scores = search(q_rows, vectors, np.array([start[r] for r in q_rows.tolist()]), c_ids, c, k, c_rows)
                name = dict(zip(q_rows.tolist(), q_ids.tolist()))
                for into, x in zip(out, ([name[r] for r in rows], rows, hits, scores)):
                    into.extend(x)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "query_row", "vec_id", "score"), out)})

    hits = q.groupBy("block", "stripe").cogroup(c.groupBy("block", "stripe")).applyInArrow(group, "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(tables(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)


SQL = """
with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] e from embeddings
           where embedding is not null and len([x for x in embedding if x is null or not isfinite(cast(x as double))]) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
