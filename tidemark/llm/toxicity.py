"""Toxicity grades by cumulative-link ordinal regression.

P(grade >= j) = sigmoid(w.x - theta_j): one weight vector over sparse word
features for all thresholds theta_1 < theta_2. The expected severity is the sum of
these probabilities.

Training uses a bounded sample of the labelled rows: of each class the
``per_class`` labelled documents that come first by a hash of doc_id. Words, and their
first and last letters, are features if their presence tells the classes apart
(chi-square over the sample);
``vocabulary`` bounds their number, so weights have a fixed size bound and are
sent to every task. Labels tell toxic from clean only; toxic training documents
get grade 2 instead of 1 if they hold more strongly toxic words than the median
toxic one. Scoring covers whole texts of all rows.

Results for odd input: null or empty text has no features and is graded by the
thresholds alone, as clean. Labels that are null, or of documents that are
missing, are left out of training. Without labelled rows of both classes nothing
can be learned and every row gets severity 0. Repeated rows are scored each; of rows that share a
labelled doc_id one trains the model, the one whose text comes first by its hash; of repeated labels the
highest counts. An empty table gives no rows; long texts are scored whole.
Columns named like an output column are replaced; all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, encode_words, row_of, slices, tables

PER_CLASS = 3_000
VOCABULARY = 2_000
#: Chi-square under which a word is no feature: at least so much, and so much for each document of the sample.
LEAST_CHI2 = (15.0, 0.01)
#: Parts of the sample that are held out in turn to find the cutoff, and steps of these fits.
FOLDS, FOLD_STEPS = 4, 300
OUT = ("p_toxic", "p_severe", "expected_severity", "grade", "toxic")

WORD = re.compile(r"[^\W_]+")


def forms(word: str) -> tuple[str, ...]:
    """A word's features: itself, and of longer ones its first four and five and its last four letters, since words are also built from stems."""
    return (word, f"{word[:4]}-", f"{word[:5]}-", f"-{word[-4:]}") if len(word) > 5 else (word,)


@dataclass
class OrdinalModel:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([np.inf, np.inf]))
    cutoff: float = 0.5  # of P(grade >= 1), from which on a document is toxic


def features(texts: pa.Array, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every known word present in a text, each once."""
    offsets, codes, names = encode_words(texts, lower=False)
    chunks: list[list[int]] = []
    at = np.full(len(names), -1, np.int64)
    for i, name in enumerate(names):
        own = sorted({words[f] for w in WORD.findall(name.lower()) for f in forms(w) if f in words})
        if own:
            at[i] = len(chunks)
            chunks.append(own)
    which = at[codes] if len(codes) else np.zeros(0, np.int64)
    keep = which >= 0
    row, which = row_of(offsets)[keep], which[keep]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, which = np.unique(np.stack([row, which]), axis=1)
    size = np.array([len(c) for c in chunks])
    flat = np.array([x for c in chunks for x in c])
    begin = np.cumsum(size) - size
    n = size[which]
    f = flat[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    row, f = np.unique(np.stack([np.repeat(row, n), f]), axis=1)
    return row, f


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and two thresholds by gradient descent (Adam) on the cumulative-link likelihood, classes weighed alike."""
    n = len(grade)
    share = np.bincount(grade, minlength=3).astype(float)
    weigh = (1 / np.maximum(share, 1))[grade]
    weigh /= weigh.sum()
    x = np.zeros(n_features + 2)  # weights, first threshold, log of the gap
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = np.bincount(row, x[feature], minlength=n)
        gap = np.exp(x[-1])
        p1, p2 = sigmoid(z - x[-2]), sigmoid(z - x[-2] - gap)
        s1, s2 = p1 * (1 - p1), p2 * (1 - p2)
        p = np.maximum(np.choose(grade, [1 - p1, p1 - p2, p2]), 1e-9)
        # d log p / d z by each threshold's part
        d1 = np.choose(grade, [-s1, s1, np.zeros(n)]) / p
        d2 = np.choose(grade, [np.zeros(n), -s2, s2]) / p
        g = np.empty_like(x)
        g[:-2] = -np.bincount(feature, ((d1 + d2) * weigh)[row], minlength=n_features) + l2 * x[:-2]
        g[-2] = ((d1 + d2) * weigh).sum()
        g[-1] = (d2 * weigh).sum() * gap
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-2], np.array([x[-2], x[-2] + np.exp(x[-1])])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, vocabulary: int = VOCABULARY) -> OrdinalModel:
    """Fit on at most ``per_class`` labelled documents of each class."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    parts = [known.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (F.col("y") >= 1, F.col("y") < 1)]
    sample = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # 2 * per_class ids at most
    # one row of each id: first its hash, so that only that row's text is moved
    first = sample.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h"))
    sample = sample.join(F.broadcast(first.withColumnRenamed("doc_id", "d")), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h"))).select("doc_id", "text", "y").dropDuplicates(["doc_id"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            offsets, codes, names = encode_words(b.column("text"), lower=False)
            for i, (doc, y) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist())):
                own = sorted({f for c in np.unique(codes[offsets[i] : offsets[i + 1]]) for w in WORD.findall(names[c].lower()) for f in forms(w)} | {""})
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(own), pa.int64()), "y": pa.array([y] * len(own), pa.int32()), "word": pa.array(own, pa.string())})

    seen = cut(sample.mapInArrow(words, "doc_id long, y int, word string"))
    count = seen.groupBy("word").agg(F.count_if(F.col("y") >= 1).alias("a"), F.count_if(F.col("y") < 1).alias("b"))
    total = {r["word"]: (r["a"], r["b"]) for r in count.filter(F.col("word") == "").collect()}
    n1, n0 = total.get("", (0, 0))  # every document has the empty word once
    if not n1 or not n0:
        return OrdinalModel()
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (F.lit(float(n1)) * n0 * (a + b) * F.greatest(F.lit(n1 + n0) - a - b, F.lit(0.5)))
    chosen = count.filter((F.col("word") != "") & (F.col("a") + F.col("b") >= 5)).withColumn("chi2", chi2).filter(F.col("chi2") >= max(LEAST_CHI2[0], LEAST_CHI2[1] * (n1 + n0)))
    chosen = chosen.orderBy(F.desc("chi2"), "word").limit(vocabulary).collect()
    index = {r["word"]: i for i, r in enumerate(chosen)}
    rate = np.array([((r["a"] + 0.5) / (n1 + 1)) / ((r["b"] + 0.5) / (n0 + 1)) for r in chosen])
    kept = seen.join(F.broadcast(seen.sparkSession.createDataFrame([(w, i) for w, i in index.items()] or [("", -1)], "word string, f int")), "word", "left")
    # each sample document's features: its vocabulary words, at most ``vocabulary``
    rows = kept.groupBy("doc_id").agg(F.max("y").alias("y"), F.collect_list("f").alias("f")).orderBy("doc_id").collect()
    row = np.repeat(np.arange(len(rows)), [len(r["f"]) for r in rows])
    feature = np.array([i for r in rows for i in r["f"]], np.int64)
    row, feature = row[feature >= 0], feature[feature >= 0]
    y = np.array([r["y"] for r in rows])
    strong = np.bincount(row, (rate[feature] >= 20).astype(float), minlength=len(rows)) if len(rate) else np.zeros(len(rows))
    grade = np.where(y > 1, np.minimum(y, 2), np.where(y == 1, 1 + (strong > np.median(strong[y >= 1])), 0)) if y.max() <= 1 else np.minimum(y, 2)
    if not len(index):
        return OrdinalModel()
    weights, thresholds = fit(row, feature, grade.astype(np.int64), len(index))
    # each document by a model that has not seen it
    p = np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        use = fold[row] != k
        order = np.cumsum(fold != k) - 1
        w, t = fit(order[row[use]], feature[use], grade[fold != k].astype(np.int64), len(index), steps=FOLD_STEPS)
        p[fold == k] = sigmoid(np.bincount(row, w[feature], minlength=len(rows)) - t[0])[fold == k]
    # halfway, in proportion, between where nearly all clean ones end and nearly all toxic ones begin
    low, high = np.quantile(p[grade == 0], 0.995), np.quantile(p[grade > 0], 0.005)
    return OrdinalModel(index, weights, thresholds, min(0.5, max(0.05, float(np.sqrt(low * high)))) if low < high else 0.5)


def grade_documents(docs: DataFrame, model: OrdinalModel, cutoff: float | None = None, text: str = "text") -> DataFrame:
    """All rows and columns plus p_toxic, p_severe, expected_severity, grade and toxic (p_toxic reaches the model's cutoff, or the one given)."""
    cutoff = model.cutoff if cutoff is None else cutoff
    rest = docs.drop(*OUT)
    fields = [*rest.schema.fields, *(T.StructField(n, t) for n, t in zip(OUT, (T.DoubleType(), T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType())))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            row, f = features(b.column(text), model.words)
            z = np.bincount(row, model.weights[f], minlength=b.num_rows) if len(row) else np.zeros(b.num_rows)
            p = [np.where(np.isfinite(t), sigmoid(z - t), 0.0) for t in model.thresholds]
            columns = [*p, p[0] + p[1], ((p[0] >= cutoff).astype(np.int32) + ((p[0] >= cutoff) & (p[1] >= 0.5))).astype(np.int32), p[0] >= cutoff]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), *map(pa.array, columns)], names=[f.name for f in fields])

    return rest.mapInArrow(score, T.StructType(fields))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, tables(spark, sf_dir, "labels"))
    return grade_documents(docs, model).drop("text")
