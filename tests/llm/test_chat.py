import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

ROWS = [
    (1, 0, "system", "be <|im_end|> kind\\"), (1, 1, "user", "<\\|im_start|>\\<|x\\\\"), (1, 2, "assistant", "a\n<|nl|>😀"), (1, 3, "assistant", "b"),
    (2, 0, "user", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (2, None, None, "first"), (3, 5, "we<|ird\nrole\\", ""), (None, 0, "user", "x"), (4, 0, "assistant", "é" * 100000),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(chat.canonical_turns(df))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        rows = sorted((r for r in ROWS if r[0] == conv), key=order)
        r = got[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in rows]
        assert r["loss_texts"] == [x[3] or "" for x in rows if x[2] == "assistant"]
        assert r["formatted"].count(chat.START) == len(rows) == r["formatted"].count("<|im_end|>\n")
    assert chat.format_chats(chat.canonical_turns(df.limit(0))).count() == 0


def test_query_digest(spark, tmp_path):
    spark.createDataFrame(ROWS[:4], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op4_chat(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in ROWS[:4]))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(ROWS[2][3]) + 1, sha(ROWS[2][3] + "b"))
    assert (got[-1]["n_turns"], got[-1]["loss_sha256"]) == (2, sha(chat.PROBE))


RECORDS = {
    "prompt_completion": {"prompt": "q", "completion": "a"}, "instruction_input": {"instruction": "q", "input": "", "output": "a"}, "question_answer": {"question": "q", "answer": "a"},
    "messages": {"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}]}, "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
}


@pytest.mark.parametrize("name", RECORDS)
def test_layouts(spark, name):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(RECORDS[name] | {"id": 7, "note": "x"})]))
    assert chat.layout_of(df.schema).name == name
    want = [("user", "q"), ("assistant", "a")]
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(df, "id").orderBy("turn").collect()] == want


def test_mixed_records(spark):
    rows = [(i, json.dumps(r | {"other": 1})) for i, r in enumerate(RECORDS.values())] + [(98, None), (99, "{broken"), (100, '{"nothing": 1}')]
    out = chat.canonical_turns_json(spark.createDataFrame(rows, "conv_id long, record string"), "record")
    got = out.groupBy("conv_id", "layout").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).collect()
    assert {r["layout"]: [(t["role"], t["text"]) for t in r["t"]] for r in got} == {n: [("user", "q"), ("assistant", "a")] for n in RECORDS}


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "x int"))
