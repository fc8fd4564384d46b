"""A training-corpus pipeline over ``documents``: five stages, each written and reread.

Stages return the columns of documents, but the last, which returns packed pieces.

Results for odd input: null and empty texts are clean and pass all filters, as one end token each. Rows of one
doc_id with different texts are judged each, but for the line stage, where they count as one document's; rows that repeat doc_id and text become one in the join. Rows whose doc_id is
null are scored for toxicity and packed; the stages between keep them as they are. Very long texts are
read whole. An empty table gives no rows. Extra columns, of any name, pass through up to the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from tidemark.llm.common import discard, shared_dir, tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on ``labels``, does not grade as toxic."""
    model = toxicity.train(docs, tables(spark, sf_dir, "labels"))
    return toxicity.grade_documents(docs, model).filter("not toxic").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines, of any length, that an earlier line resembles; a document that such lines leave without any word goes."""
    out = line_dedup.dedup_lines(docs, least_words=1)
    lost = F.size("lines_removed") > 0
    out = out.filter(~lost | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group that five-word shingles link at a similarity of 0.8."""
    return ngram_join.one_of_each(docs, k=5, threshold=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of ``benchmark``."""
    return decontamination.remove(docs, tables(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is kept in the shared folder until the next one is written."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = tables(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if before:
            discard(spark, before)
        before = f"{at}/{k}"
    return docs
