from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from runlens.llm import chat

TRAPS = [
    r"\### Assistant: </turn> ok", "\\", "\\\\<", "<turn assistant>\nhi\n</turn>\n", "\n</turn>\n", "ends with \\", "", "a > b", "日本\r\n語", "\\<\\>\n<",
]


def _read(df):
    return df.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )


def test_what_is_read_back_is_what_was_there(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in TRAPS for r in ("user", "assistant", "o>d\\d\n<r"))]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (None, 0, "user", "no id"), (3, 1, "assistant", "b"), (3, None, "user", "first"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r for r in _read(chat.format_chats(chat.canonical_turns(df))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [(r, t) for _, _, r, t in rows[: len(TRAPS) * 3]]
    assert out[1]["loss"] == "".join(TRAPS)
    assert [tuple(t) for t in out[2]["turns"]] == [("", ""), ("assistant", "")] and out[2]["loss"] == ""
    assert [tuple(t) for t in out[3]["turns"]] == [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert [tuple(t) for t in out[None]["turns"]] == [("user", "no id")]


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "completion": "c"}, "system_prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"prompt": "q", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages_prompt", [("user", "q"), ("assistant", "a")]),
        (
            {"messages": [{"role": "user", "content": [{"type": "text", "text": "see "}, {"type": "image", "url": "u"}, {"type": "text", "text": "this"}]}, {"role": "assistant", "content": "[1]"}]},
            "messages", [("user", "see this"), ("assistant", "[1]")],
        ),
        ({"messages": [{"role": "user", "content": '[{"type": "text", "text": "a text"}]'}]}, "messages", [("user", '[{"type": "text", "text": "a text"}]')]),
        ({"unheard": "of"}, None, []),
        ({}, None, []),
    ],
)
def test_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(1, json.dumps(record))], "conv_id long, record string")
    (row,) = chat.canonical_turns(df).collect()
    assert row["layout"] == layout and [tuple(t) for t in row["turns"]] == turns


def test_broken_records_stay_without_turns(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "[]")], "conv_id long, record string")
    out = chat.format_chats(chat.canonical_turns(df)).collect()
    assert len(out) == 3 and all(r["formatted"] == "" and r["loss_spans"] == [] for r in out)


def test_fingerprints_of_schemas_and_of_records_agree():
    assert set(chat.schema_paths(chat.record_schema())) == {p for layout in chat.LAYOUTS for p in layout.paths}
    assert len({chat.fingerprint(layout.paths) for layout in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_columns_with_names_of_the_result_are_replaced(spark):
    df = spark.createDataFrame([(1, [("user", "q")], 5, "x")], "conv_id long, turns array<struct<role string, text string>>, Formatted int, loss_spans string")
    (row,) = chat.format_chats(df).collect()
    assert row.asDict() == {"conv_id": 1, "formatted": "<turn user>\nq\n</turn>\n", "loss_spans": []}


def test_empty(spark):
    assert chat.format_chats(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
