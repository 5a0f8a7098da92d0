"""Chat records that mix two layouts, and records that no layout reads."""

from __future__ import annotations

import json

import pytest

from llm import chat

SAID = [("user", "hi"), ("assistant", "hello")]
MESSAGES = [{"role": role, "content": text} for role, text in SAID]


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"instruction": "add", "input": "1 2", "output": "3", "text": "### add 1 2: 3"}, [("user", "add\n1 2"), ("assistant", "3")]),
        ({"instruction": "hi", "output": "hello", "text": "hi hello"}, SAID),
        ({"instruction": "who", "context": "a story", "response": "she"}, [("user", "who\na story"), ("assistant", "she")]),
        ({"instruction": "hi", "response": "hello", "category": "talk"}, SAID),
        ({"prompt": "hi", "prompt_id": "7", "messages": MESSAGES}, SAID),
        ({"prompt": "hi", "messages": ["hi", "hello"]}, SAID),
        ({"messages": ["hi", "hello"]}, SAID),
        ({"system": "be brief", "messages": ["hi"]}, [("system", "be brief"), ("user", "hi")]),
        ({"messages": ["hi", None, "more"]}, [("user", "hi"), ("user", "more")]),
        ({"messages": ["", 5]}, [("user", ""), ("assistant", "5")]),
        ({"question": "who", "context": "a story", "answer": "she"}, [("user", "a story\nwho"), ("assistant", "she")]),
        ({"role": "user", "text": "hi", "context": "a story"}, [("user", "hi")]),
        ({"prompt": "hi", "response": "hello", "text": "hi hello"}, SAID),
    ],
)
def test_layouts_that_stand_together(record, turns):
    assert chat.turns_of(record) == turns


def test_lists_of_two_kinds_have_no_layout():
    assert chat.turns_of({"messages": ["hi", MESSAGES[1]]}) == []
    assert chat.turns_of({"messages": [["hi"]]}) == []


def test_each_record_is_formatted_or_told(spark):
    unknown = {"title": "x", "body": {"parts": ["a", "b"], "none": None}}
    records = [
        json.dumps({"messages": ["hi", "hello"]}), json.dumps(unknown), json.dumps(unknown), json.dumps({"title": "y", "body": {"parts": []}}),
        "[1]", "not json", "", None, "{}", '{"messages": []}', "5", "[" * 100_000,
    ]
    df = spark.createDataFrame([(i, r, "other") for i, r in enumerate(records)], "id int, record string, reason string").repartition(3)
    formatted = {r.id for r in chat.pieces(df, ["id"]).collect()}
    found = {r.id: r for r in chat.unmapped(df, ["id"]).collect()}
    assert formatted == {0} and set(found) == set(range(1, len(records)))
    assert {i: found[i].reason for i in found} == {
        1: "no layout", 2: "no layout", 3: "no layout", 4: "no object", 5: "no object", 6: "no record", 7: "no record",
        8: "no layout", 9: "no layout", 10: "no object", 11: "no object",
    }
    assert found[1].fields == "body.parts[]\ntitle" and found[1].fingerprint == f"{chat.fingerprint(['title', 'body.parts[]']):016x}"
    assert found[8].fields == "" and found[4].fingerprint is None
    counts = {(r.reason, r.fields): r.records for r in chat.unmapped_layouts(df).collect()}
    assert counts == {("no layout", "body.parts[]\ntitle"): 2, ("no layout", "title"): 1, ("no layout", ""): 2, ("no object", None): 4, ("no record", None): 2}
    assert sum(counts.values()) + len(formatted) == len(records)


def test_no_records(spark):
    df = spark.createDataFrame([], "id int, record string")
    assert chat.unmapped(df, ["id"]).isEmpty() and chat.unmapped_layouts(df).isEmpty()
