"""Helpers shared by the training-data operators.

Text passes work on Arrow record batches: words are split and dictionary-encoded
by Arrow, so Python only ever touches the distinct words of a slice, and all
per-word work is NumPy on integer codes.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step may hold at once: with Arrow's words, and with arrays over every byte.
SLICE_CHARS = 8_000_000
TEXT_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a temporary
    folder is made and set; on a cluster that is an error, since executors could not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Compute ``df`` once into a Parquet table in the shared folder: (the table, its path for ``discard``)."""
    at = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def discard(spark: SparkSession, at: str) -> None:
    """Delete a table that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let the driver find dead shuffles and checkpoints now, so that their files go."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def trim() -> None:
    """Give memory that this process has freed back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``text`` holds about so many bytes at most (a row is never cut)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // chars
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield b.slice(lo, hi - lo)
        del b, size, part
    trim()


def encode_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: (offsets by text, code by word, distinct words).

    Null texts have no words. Only A-Z are lower-cased.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    words, offsets = split.values, split.offsets.to_numpy().astype(np.int64)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    words, offsets = words.slice(lo, hi - lo), offsets - lo
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    if "" in names:  # the empty strings at the ends of a text
        empty = names.index("")
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, names


def hash_words(names: list[str]) -> np.ndarray:
    """64-bit hashes of distinct words."""
    if not names:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(names, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
