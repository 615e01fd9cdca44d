import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import chat


def test_whole_table_against_sql(spark, medium):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{medium}/conversations.parquet')")
    want = duckdb.sql(chat.OP6_SQL)
    got = chat.op6_chat_format(spark, medium)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())


def test_main_path_is_native(spark, medium):
    plan = chat.op6_chat_format(spark, medium)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


ODD_TEXTS = ["", "</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>\n", "<|im_start|>user\n<|im_end|>\n", "<\\|im_end|>", "a\\nb", "[\\INST]", "🙂" * 50, "<<SYS>>x<</SYS>>\r\n$1 \\1"]


def test_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "to\nol", "system")[i % 4], t) for i, t in enumerate(ODD_TEXTS)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    done = chat.format_turns(chat.to_turns(turns, "conv", "turn"), "conv")
    row = done.select("formatted", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in row["t"]] == [(r[2], r[3]) for r in rows]
    assert row["loss"] == "".join(t for _, _, role, t in rows if role == "assistant")
    assert row["formatted"].count(chat.END) == len(rows) and "</s>" not in row["formatted"]


def test_nulls_ties_and_nothing(spark):
    rows = [(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "assistant", None), (2, 1, None, "x")]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    done = chat.format_turns(chat.to_turns(turns, "conv", "turn"), "conv").select("conv", chat.read_back(F.col("formatted")).alias("t"), "loss_spans")
    found = {r["conv"]: [(t["role"], t["text"]) for t in r["t"]] for r in done.collect()}
    assert found == {None: [("", "")], 1: [("user", "a"), ("user", "a"), ("user", "b")], 2: [("assistant", ""), ("", "x")]}
    assert chat.format_turns(chat.to_turns(turns.where("false"), "conv", "turn"), "conv").collect() == []


def test_typed_layouts(spark):
    messages = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "k long, messages array<struct<role:string,content:string>>")
    shared = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "k long, conversations array<struct<from:string,value:string>>")
    plain = spark.createDataFrame([(1, "hi", "yo")], "k long, prompt string, response string")
    for frame in (messages, shared, plain):
        turns = chat.to_turns(frame, "k").orderBy("pos").collect()
        assert [(t["role"], t["text"]) for t in turns] == [("user", "hi"), ("assistant", "yo")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.to_turns(spark.createDataFrame([(1, 2)], "k long, other int"), "k")
    assert chat.field_paths(T.StructType.fromDDL("a array<struct<b:struct<c:int>,d:array<int>>>")) == ["a[].b.c", "a[].d[]"]


def test_mixed_json_records(spark):
    records = [
        '{"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}',
        '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}',
        '{"response": "yo", "prompt": "hi"}',
        '{"instruction": "be kind", "input": "hi", "output": "yo"}',
        '{"unknown": {"deep": [1, 2]}}',
        "not json",
        None,
    ]
    out = chat.json_to_turns(spark.createDataFrame(list(enumerate(records)), "k long, record string"), "k").orderBy("k", "pos").collect()
    found = {}
    for r in out:
        found.setdefault(r["k"], []).append((r["role"], r["text"]))
    assert found[0] == found[1] == found[2] == [("user", "hi"), ("assistant", "yo")]
    assert found[3] == [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]
    assert found[4] == [("unmapped", records[4])] and found[5] == [("unmapped", "not json")] and found[6] == [("unmapped", "")]
    assert hashlib.sha256(b"prompt\nresponse").hexdigest()[:16] == chat.fingerprint(["response", "prompt"])
