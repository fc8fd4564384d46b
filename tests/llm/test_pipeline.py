"""The pipeline on a small fixture, against a brute-force version of its stages."""

import random

import corpus_pipeline
from tests.llm.helpers import DOCS, documents, group_ids, shingle_set
from tests.llm.test_joins import expected_lines
from tests.llm.test_packing import check, tokenizer  # noqa: F401


def fixture(spark, at):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    texts = ["\n".join(text(rng.randint(8, 30)) for _ in range(rng.randint(1, 4))) for _ in range(90)]
    toxic = []
    for i in range(0, 90, 6):
        toxic.append(i)
        texts[i] += " " + " ".join(rng.choice(["foul", "nasty", "vile"]) for _ in range(3))
    items = [text(25) for _ in range(5)]
    leaks = list(range(1, 90, 9))
    for k, i in enumerate(leaks):
        texts[i] += "\n" + text(6) + " " + items[k % 5] + " " + text(6)
    texts[50] = texts[3]
    texts[51] = texts[7] + " extra"
    shared = text(60)
    for i in (20, 40, 70):
        texts[i] += "\n" + shared
    texts += ["", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return texts, toxic, leaks


def test_pipeline(spark, tmp_path, tokenizer):  # noqa: F811
    texts, toxic, leaks = fixture(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = {i: t for i, t in enumerate(texts) if i not in toxic}
    cleaned = expected_lines(list(docs.values()))
    kept = {}
    for i, (t, gone) in zip(docs, cleaned):
        left = [x for x in (t or "").split("\n") if len(set(x.split())) >= 5]
        if not gone or left:
            kept[i] = t
    group = group_ids({i: shingle_set(t, 5) for i, t in kept.items()}, 80, 100)
    kept = {i: t for i, t in kept.items() if group[i] == i and i not in leaks}
    renumber = {i: k for k, i in enumerate(kept)}
    assert {r["doc_id"] for r in rows} == kept.keys()
    used, least = check([r.asDict() | {"doc_id": renumber[r["doc_id"]]} for r in rows], list(kept.values()), tokenizer, 4096)
    assert used <= least + 1
    assert 50 not in kept and {20} <= kept.keys()


def test_stages_keep_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_odd_rows(spark, tmp_path):
    """Repeated and null ids, empty and null texts, clashing names, no rows at all."""
    fixture(spark, str(tmp_path))
    clean = ["one clean text of quite a few words", "another clean text with words of its own"]
    rows = [(1, clean[0]), (1, clean[1]), (2, ""), (3, None), (None, clean[0]), (None, None), (4, clean[0]), (5, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, "k", i, 0) for i, t in rows], "doc_id long, text string, kept string, root long, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        left = sorted((str(r["doc_id"]), str(r["text"])[:50]) for r in out.collect())
        want = sorted((str(i), str(t)[:50]) for i, t in rows)
        if name == "line_dedup":
            # document 4's line was document 1's
            assert left == [w for w in want if w != ("4", clean[0])]
        elif name == "ngram_join":
            assert left == [w for w in want if w != ("4", clean[0])]
        else:
            assert left == want
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sum(r["doc_id"] is None for r in packed) == 2 and {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5, None}
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_short_lines_keep_their_document(spark, tmp_path):
    shared = ["alpha beta gamma delta epsilon", "one two three four five six"]
    texts = ["\n".join(shared), f"{shared[0]}\nOur own\nshort lines\n{shared[1]}", f"{shared[0]}\n \n{shared[1]}", shared[0]]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_lines(spark, documents(spark, texts), str(tmp_path)).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("Our own\nshort lines", 19)}


def test_short_lines_go_as_well(spark, tmp_path):
    texts = ["All rights reserved.\nfirst", "one two three four\nRESERVED. all rights\n\nsecond", "all rights reserved.\nfirst", "five one two three four", "six one two", ""]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, documents(spark, texts), str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "one two three four\n\nsecond", 4: texts[4], 5: ""}
