"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL ``.host/path``. All globs are packed
side by side into multiword Shift-And masks, so one pass over a URL's bytes
steps all rules at once; a batch of URLs is stepped together, word by word.

Glob syntax: ``*`` any run of characters but ``/`` (as in a host), ``**`` any
run at all, ``?`` one character. Everything else stands for itself.

Results for odd input: a null URL, or one without ``://``, has empty host and
path, fits no rule and gets the default verdict. Rows are judged one by one, so
repeated rows each get the same result; other columns pass through. Where two
fitting rules are equally long, the one with the longer host wins, then block.
An empty table gives no rows. Very long URLs are judged whole; their bytes are stepped only
until every glob has failed or fits whatever follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, tables

STEP_ROWS = 16_384
#: Bytes after which it is seen whether any glob is still open.
SETTLED_EVERY = 64


@dataclass(frozen=True)
class UrlRule:
    """``action`` (allow or block) for a host with all its subdomains and a path prefix."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class Automaton:
    """Shift-And masks of many globs.

    A glob takes one start bit and one bit for each literal or ``?``. On byte c
    the state D becomes ((D << 1) & step[c]) | (D & stay[c]): ``stay`` holds the
    bits in front of a star, which remain set while the star takes bytes.
    """

    def __init__(self, globs: Sequence[str]):
        places: list[tuple[int, bytes]] = []
        stays: list[tuple[int, str]] = []
        starts, ends, at = [], [], 0
        for glob in globs:
            starts.append(at)
            i = 0
            while i < len(glob):
                c = glob[i]
                if c == "*":
                    deep = glob[i : i + 2] == "**"
                    stays.append((at, "all" if deep else "label"))
                    i += 1 + deep
                    continue
                if c == "?":
                    at += 1
                    places.append((at, bytes(b for b in range(256) if b & 0xC0 != 0x80)))
                    stays.append((at, "tail"))  # the other bytes of the character
                else:
                    for b in c.encode():
                        at += 1
                        places.append((at, bytes([b])))
                i += 1
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for bit in starts:
            self.start[bit >> 6] |= np.uint64(1 << (bit & 63))
        for bit, chars in places:
            self.step[list(chars), bit >> 6] |= np.uint64(1 << (bit & 63))
        for bit, kind in stays:
            chars = [b for b in range(256) if kind == "all" or (kind == "label" and b != ord("/")) or (kind == "tail" and b & 0xC0 == 0x80)]
            self.stay[chars, bit >> 6] |= np.uint64(1 << (bit & 63))
        self.ends = np.array(ends, np.int64)
        # bits that stay whatever comes: ends of globs with a deep star behind
        self.final = np.bitwise_and.reduce(self.stay, axis=0)
        self.final &= self.bits(self.ends)

    def bits(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for bit in at.tolist():
            out[bit >> 6] |= np.uint64(1 << (bit & 63))
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Which globs fit which whole texts: bool (texts, globs)."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        begin = (np.cumsum(size) - size)[order]
        length = size[order]
        state = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for i in range(int(length[0]) if len(texts) else 0):
            live = int(np.searchsorted(-length[:live], -i, side="left"))  # those longer than i come first
            c = data[begin[:live] + i]
            d = state[:live]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (d & self.stay[c])
            if i % SETTLED_EVERY == SETTLED_EVERY - 1 and not (state[:live] & ~self.final).any():
                break  # nothing that is left can change
        out = np.zeros((len(texts), len(self.ends)), bool)
        out[order] = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def filter_urls(df: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``df`` plus host, path, canonical, rule and verdict (columns of those names are replaced)."""
    added = ["host", "path", "canonical", "rule", "verdict"]
    rest = df.drop(*added)
    work = rest.withColumn("__url", F.col(f"`{url}`"))
    start = F.expr("coalesce(if(instr(__url, '://') > 0, substring(__url, locate('://', __url) + 3), ''), '')")
    work = work.withColumn("__rest", start)
    host = F.translate(F.substring_index(F.translate("__rest", "?#", "//"), "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    work = work.withColumn("host", host)
    work = work.withColumn("path", F.substring_index(F.translate(F.expr("substring(__rest, length(host) + 1)"), "?", "#"), "#", 1))
    work = work.withColumn("canonical", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit("")).otherwise(F.concat(F.lit("."), "host", "path")))
    work = work.drop("__url", "__rest")
    ranked = sorted(rules, key=lambda r: (len(r.name), len(r.host), r.action == "block", r.name))
    automaton = Automaton([r.glob for r in ranked])
    names = pa.array([r.name for r in ranked] + [None], pa.string())
    actions = pa.array([r.action for r in ranked] + [default], pa.string())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in slices(batches, "canonical"):
            for lo in range(0, big.num_rows, STEP_ROWS):
                b = big.slice(lo, STEP_ROWS)
                fits = automaton.run(pc.cast(b.column("canonical"), pa.binary()).to_pylist())
                # the last fitting rule in ranked order, or the extra entry for none
                best = np.where(fits.any(axis=1), fits.shape[1] - 1 - np.argmax(fits[:, ::-1], axis=1), len(ranked)) if ranked else np.full(b.num_rows, len(ranked))
                columns = [b.column(i) for i in range(b.num_columns)] + [names.take(pa.array(best)), actions.take(pa.array(best))]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "rule", "verdict"])

    fields = [*work.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    return work.mapInArrow(judge, T.StructType(fields))


#: The rules of the registered query.
PAGE_RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') rawhost from u),
p as (select page_id, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(substr(rest, length(rawhost) + 1), '^[^?#]*') path from h),
r(action, rhost, rpath) as (values ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                                   ('allow','com','/fr/'), ('block','com','/de/')),
m as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as verdict
      from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (page_id)
"""
