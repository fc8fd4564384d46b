"""Line dedup, the n-gram join and components, against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents, group_ids, shingle_set, similar, words
from tidemark.llm import setjoin
from tidemark.llm.components import components
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import join_documents, one_of_each
from tidemark.llm.words import distinct

ODD = ["", None, " \n ", "one", "one", "ONE two", "a b c", "A b\tc", "x " * 30000, "x " * 30000 + "y"]


def check_join(spark, texts, k, num, den, **how):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_documents(documents(spark, texts), k, (num, den), **how).collect()}
    sets = {i: shingle_set(t, k) for i, t in enumerate(texts)}
    group = group_ids(sets, num, den)
    assert got == {i: (len(s), group[i]) for i, s in sets.items()}
    return group


@pytest.mark.parametrize("k, num, den, orders", [(3, 90, 100, 2), (5, 80, 100, 2), (1, 60, 100, 3)])
def test_join(spark, k, num, den, orders):
    group = check_join(spark, corpus(k) + ODD, k, num, den, orders=orders)
    assert len(set(group.values())) < len(group) - 10


def test_join_with_hot_tokens(spark, monkeypatch):
    """Tiny blocks and groups: every path of open rows and split tokens is taken."""
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "SMALL", 4)
    monkeypatch.setattr(setjoin, "CHUNK", 50)
    check_join(spark, corpus(9, n=150, vocabulary=12, length=(8, 30)), 1, 80, 100)
    check_join(spark, corpus(8, n=150, vocabulary=300, length=(30, 40)), 2, 70, 100)


def shrink(monkeypatch, **sizes):
    for name, n in dict(BLOCK=8, SMALL=4, CHUNK=50, CHUNK_MAPS=20, OPEN_BLOCK=5, MAP_FROM=10, LIMIT=12).items():
        monkeypatch.setattr(setjoin, name, sizes.get(name, n))


@pytest.mark.parametrize("cap, limit", [(1, 12), (2, 1000), (2, 3)])
def test_second_round(spark, monkeypatch, cap, limit):
    """Groups that are cut off or too large, dealt anew, with parity maps: families of near copies whose pairs lie on both sides of the threshold."""
    shrink(monkeypatch, LIMIT=limit)
    monkeypatch.setattr(setjoin, "CAP", cap)
    rng = random.Random(cap + limit)
    texts = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60 + 30 * family)]
        for rate in rng.choices([0.01, 0.05, 0.09], k=30):
            own = [w if rng.random() > rate else rng.choice(["the", "of", f"x{rng.randint(0, 99)}"]) for w in base]
            texts.append(" ".join(own))
    group = check_join(spark, texts, 1, 88, 100)
    assert 8 < len(set(group.values())) < 110
    check_lines(spark, ["\n".join(texts[i : i + 3]) for i in range(0, 120, 3)])


def test_groups_of_any_size():
    """Pieces of too large tokens are marked, class rows collapse to their first unit, nothing else is lost."""
    rng = random.Random(3)
    tokens = sorted([*range(40)] + [7] * 100 + [19] * 55 + [rng.randint(0, 40) for _ in range(60)])
    rows = [(t, 0, setjoin.IS_CLASS if t == 19 else 0, 1 if t == 19 else i, 0, 0, i) for i, t in enumerate(tokens)]
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + step])], names=list(setjoin.POSTING)) for lo in range(0, len(rows), step)]
        seen = []
        for large, g in setjoin.groups(iter(batches), 20, 30):
            assert not large or set(g["token"].tolist()) == {7}
            seen += list(zip(g["token"].tolist(), g["doc"].tolist()))
        if step < 1000:
            assert len([1 for t, _ in seen if t == 19]) < 55
        want = [(r[0], r[6]) for r in rows]
        first = min(w for w in want if w[0] == 19)
        assert [w for w in seen if w[0] != 19] == [w for w in want if w[0] != 19] and first in seen


def test_tokens_that_share_their_first_bits():
    """Sets come in the order of whole tokens, whatever the order they are met in."""
    a, b, c = (np.uint64((77 << 40) + x) for x in (5, 9, 1 << 23))
    for order in itertools.permutations([a, b, c, a, b, a]):
        offsets, token = distinct(np.zeros(6, np.int64), np.array(order, np.uint64), 1)
        assert token.tolist() == [a, b, c] and offsets.tolist() == [0, 3]
    row = np.array([(1 << 24) + 5, 0, (1 << 24) + 5, 1 << 24])
    offsets, token = distinct(row, np.array([b, c, a, a], np.uint64), (1 << 24) + 6)
    assert token.tolist() == [c, a, a, b] and offsets[-1] == 4


def test_sets_that_share_a_signature():
    """Rows of one signature are one class only if size and parity maps agree as well."""
    rows = {k: np.array(v, np.int64) for k, v in dict(token=[1] * 6, at=[5 << 32, 5 << 32, 5 << 32, 6 << 32, 5 << 32, 5 << 32], tail=[0] * 6, sig=[9] * 5 + [8], b0=[3, 4, 3, 3, 4, 3], b1=[0] * 6, doc=[7, 2, 1, 5, 6, 4]).items()}
    for group in ((), (np.zeros(6, np.int64),)):
        got = setjoin.first_units(rows, *group)
        assert sorted(zip(got["sig"].tolist(), (got["at"] >> 32).tolist(), got["b0"].tolist(), got["doc"].tolist())) == [(8, 5, 3, 4), (9, 5, 3, 1), (9, 5, 4, 2), (9, 6, 3, 5)]
    group = setjoin.Group(rows, setjoin.Threshold(80, 100))
    assert all(rows["sig"][i] != rows["sig"][j] for i, j in zip(*group.passing(*np.triu_indices(6, 1))))


def test_ordinary_tokens_are_not_dealt_out():
    """In a sketch whose every bucket holds a thousand tokens, only what stands out is split."""
    counts = np.random.default_rng(0).poisson(50_000, 4096).astype(float)
    counts[7] += 400_000
    codes = np.floor(8 * np.log2(counts + 1)).astype(np.uint8)
    blocks = setjoin.hot_blocks(codes)[codes]
    assert np.delete(blocks, 7).max() == 1 and blocks[7] >= 400_000 / setjoin.BLOCK
    few = np.zeros(4096)
    few[:5] = [3 * setjoin.BLOCK, 10, setjoin.BLOCK // 2, 1, 1]
    codes = np.floor(8 * np.log2(few + 1)).astype(np.uint8)
    assert setjoin.hot_blocks(codes)[codes][:5].tolist() == [3, 1, 1, 1, 1]


def test_join_odd_rows(spark):
    df = documents(spark, ["a b c d e f", ("a b c d e f",), "a b c d e f"]).unionByName(documents(spark, ["a b c d e f"]))
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in join_documents(df.withColumnRenamed("lang", "component_id")).collect())
    assert rows == [(False, 0, 0), (False, 0, 0), (False, 2, 0), (True, 0, None)]
    assert join_documents(df.limit(0)).count() == 0


def expected_lines(texts, least=5, num=80, den=100):
    before, out = [], []
    for t in texts:
        kept, gone = [], []
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if len(s) >= least:
                if any(similar(s, b, num, den) for b in before):
                    gone.append(i)
                before.append(s)
            if i not in gone:
                kept.append(line)
        out.append((t if not gone else "\n".join(kept), gone))
    return out


def line_texts(seed, n):
    rng = random.Random(seed)
    lines = corpus(seed, n=200, vocabulary=40, length=(1, 25))
    return ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(n)] + ["", None, "\n\n", "w " * 20000, " ".join(f"u{i}" for i in range(3000)), " ".join(f"u{i}" for i in range(2800))]


def check_lines(spark, texts):
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in dedup_lines(documents(spark, texts)).collect()}
    want = dict(enumerate(expected_lines(texts)))
    assert got == want
    return sum(len(g) for _, g in want.values())


def test_lines(spark):
    assert check_lines(spark, line_texts(1, 60)) > 50


def test_lines_with_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "SMALL", 4)
    monkeypatch.setattr(setjoin, "CHUNK", 50)
    check_lines(spark, line_texts(2, 40))


def test_lines_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "SMALL", 4)
    texts = line_texts(3, 40) + ["ODD one\none odd one", "w1 w2 w3\nw3 w1\n \nw1 w2 w3 w4\nw1 w2 w3 w4 w5"]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in dedup_lines(documents(spark, texts), least_words=1).collect()}
    assert got == dict(enumerate(expected_lines(texts, least=1)))


def test_settled_groups_are_not_reopened(spark, monkeypatch):
    """A family larger than the cap: its first line has no candidate before it, each later one is similar to its first; nothing is left to look for."""

    def again(*_):
        raise AssertionError("second round")

    monkeypatch.setattr(setjoin, "reopened", again)
    base = [f"w{i}" for i in range(40)]
    check_lines(spark, [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(12)] + ["one of another kind altogether", "w1 w2 w3 w4 w5"])


def test_lines_order_and_odd_rows(spark):
    line = "alpha beta gamma delta epsilon"
    docs = documents(spark, [line, "x\n" + line.upper(), (line,)]).sort("doc_id", ascending=False)
    got = {r["doc_id"]: (r["text"], r["lines_removed"], r["lines_left"]) for r in dedup_lines(docs.withColumnRenamed("lang", "kept_")).collect()}
    assert got == {0: (line, [], 1), 1: ("x", [1], 0), None: (line, [], 0)}
    assert dedup_lines(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    texts = ["alpha beta gamma delta epsilon\nown", "alpha beta gamma delta epsilon\nother"]
    names = dict(zip(("lang", "source", "n_chars"), ("kept", "line", "sig")))
    docs = documents(spark, texts)
    for old, new in names.items():
        docs = docs.withColumnRenamed(old, new)
    docs = docs.withColumn("kept_", F.lit(1)).withColumn("lines_left", F.lit("x"))
    out = dedup_lines(docs)
    assert [(r["doc_id"], r["text"], r["kept"], r["kept_"], r["lines_left"]) for r in out.orderBy("doc_id").collect()] == [(0, texts[0], "en", 1, 1), (1, "other", "en", 1, 0)]
    assert [r["component_id"] for r in join_documents(docs.withColumnRenamed("kept", "root"), 2, (30, 100)).collect()] == [0, 0]


def test_one_of_each(spark):
    """Rows of one doc_id are told apart by their texts: nothing is lost with an unlinked text, and one row of each group stays."""
    a, b, c = ("one two three four five six seven", "red green blue black white brown pink", "sun moon star sky cloud rain wind")
    rows = [(5, a), (5, b), (3, a), (7, b), (9, c), (9, c), (9, f"{c} {c}"), (4, ""), (4, None), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in one_of_each(docs, 2, (80, 100)).collect())
    c_or = {("9", c), ("9", f"{c} {c}")} & set(got)
    assert len(c_or) == 1 or not similar(shingle_set(c, 2), shingle_set(f"{c} {c}", 2), 80, 100)
    assert sorted(set(got) - c_or) == sorted({("3", a), ("5", b), ("4", ""), ("4", "None"), ("None", a)}) and got.count(("None", a)) == 2
    assert one_of_each(docs.limit(0)).count() == 0 and one_of_each(docs).columns == docs.columns


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(table, few=0).collect()}
    assert got == {r["node"]: r["root"] for r in components(table).collect()}
    assert got == {x: find(x) for x in root if x in got} and set(got) >= {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
