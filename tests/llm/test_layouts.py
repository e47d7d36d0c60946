"""Layouts as a parameter, by fingerprint: common shapes give all turns, what would be lost gives a reason."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chatformat as C

U, A = ("user", "q"), ("assistant", "a")
M = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
WHOLE = [
    ({"messages": [M[0]], "output": "a"}, [U, A]),
    ({"messages": M, "output": "a"}, [U, A]),
    ({"messages": M, "answer": "b"}, [U, A, ("assistant", "b")]),
    ({"instruction": "q", "output": "a", "history": [["x", "y"], ["z", "w"]]}, [("user", "x"), ("assistant", "y"), ("user", "z"), ("assistant", "w"), U, A]),
    ({"instruction": "q", "output": "a", "history": ["x", "y"]}, [("user", "x"), ("assistant", "y"), U, A]),
    ({"instruction": "q", "output": "a", "history": M}, [U, A, U, A]),
    ({"instruction": "q", "output": "a", "history": [{"human": "x", "assistant": "y"}]}, [("user", "x"), ("assistant", "y"), U, A]),
    ({"instruction": "q", "output": "a", "history": []}, [U, A]),
    ({"prompt": [M[0]], "completion": [M[1]]}, [U, A]),
    ({"input": "q", "output": "a"}, [U, A]),
    ({"query": "q", "response": "a"}, [U, A]),
    ({"human": "q", "assistant": "a"}, [U, A]),
    ({"conversation": [{"human": "q", "assistant": "a"}, {"human": "r", "assistant": "b"}], "system": "s"}, [("system", "s"), U, A, ("user", "r"), ("assistant", "b")]),
    ({"messages": [{"speaker": "human", "text": "q"}, {"speaker": "bot", "text": "a"}]}, [U, A]),
    ({"messages": [{"role": "user", "parts": [{"text": "q"}]}, {"role": "model", "parts": [{"text": "a"}, {"text": "b"}]}]}, [U, ("model", "a\nb")]),
    ({"data": {"messages": M, "id": 1}}, [U, A]),
    ({"conversations": [["q", "a"], ["r", "b"]]}, [U, A, ("user", "r"), ("assistant", "b")]),
]
LOST = [
    ({"messages": M, "chosen": "c"}, "leaves out chosen"),
    ({"prompt": "q", "response": "a", "output": "b"}, "leaves out response"),
    ({"messages": M, "turns": M}, "leaves out turns, turns[], turns[].content, turns[].role"),
    ({"prompt": {"deep": "q"}, "response": "a"}, "no layout"),
    ({"prompt": ["q", "r"], "response": "a"}, "no layout"),
    ({"messages": ["q", "a"]}, "no layout"),
    ({"id": 1}, "no layout"),
    ("no record", "no record"),
    (None, "no record"),
]


def formatted(spark, records, **how):
    df = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, (str, type(None))) else r) for i, r in enumerate(records)], "id int, record string")
    out = C.format_chats(df, details=True, **how)
    return {r["id"]: r for r in out.select("id", "layout", "reason", "aside", "formatted", C.read_turns(F.col("formatted")).alias("turns")).collect()}


def pairs(turns):
    return [(t["role"], t["text"]) for t in turns]


def test_common_shapes_and_lost_paths(spark):
    preferred = [
        ({"prompt": "q", "chosen": "a", "rejected": "b"}, [U, A], [("rejected", "b")]),
        ({"chosen": M, "rejected": [M[0], {"role": "assistant", "content": "b"}]}, [U, A], [U, ("assistant", "b")]),
        ({"prompt": "q", "chosen": M, "rejected": M}, [U, A], [U, A]),
    ]
    got = formatted(spark, [r for r, *_ in [*WHOLE, *preferred, *LOST]])
    for i, (record, want) in enumerate(WHOLE):
        assert got[i]["layout"] and got[i]["reason"] is None and got[i]["aside"] == [] and pairs(got[i]["turns"]) == want, record
    for i, (record, want, aside) in enumerate(preferred, len(WHOLE)):
        assert pairs(got[i]["turns"]) == want and pairs(got[i]["aside"]) == aside, record
    for i, (record, reason) in enumerate(LOST, len(WHOLE) + len(preferred)):
        assert (got[i]["layout"], got[i]["reason"], got[i]["formatted"]) == (None, reason, None), record


def test_own_layouts_and_a_given_registry(spark):
    own = C.Layout("ticket", (C.Part("text", "", ("user",), (("title",), ("body",))), C.Part("list", "replies", ("who",), (("said",),))))
    records = [{"title": "t", "body": "b", "replies": [{"who": "agent", "said": "r"}]}, {"title": "t", "replies": []}, {"prompt": "q", "response": "a"}]
    got = formatted(spark, records, layouts=(own, *C.LAYOUTS))
    assert [got[i]["layout"] for i in range(3)] == ["ticket", None, "prompt_response"] and pairs(got[0]["turns"]) == [("user", "t\n\nb"), ("agent", "r")]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records * 3)], "id int, record string")
    registry = C.layout_registry(df, layouts=(own,))
    assert registry.count() == 3 and {r["layout"] for r in registry.collect()} == {"ticket", None}
    again = formatted(spark, records, layouts=(own,), registry=registry)
    assert pairs(again[0]["turns"]) == [("user", "t\n\nb"), ("agent", "r")] and again[2]["reason"] == "no layout"


def test_all_helper_names_may_be_columns(spark):
    names = ["record", "parsed", "paths", "of", "parts", "reason", "said", "listed", "turns", "pieces", "c0", "c1", "__record", "__parsed", "__json", "__said", "__turns", "__parts", "aside", "layout"]
    df = spark.createDataFrame([(json.dumps({"prompt": "q", "response": "a"}), *names)], "chat string, " + ", ".join(f"`{n}` string" for n in names))
    out = C.format_chats(df, "chat")
    row = out.first()
    assert out.columns == ["chat", *[n for n in names if n != "layout"], "fingerprint", "layout", "formatted", "loss_spans"]
    assert all(row[n] == n for n in names if n != "layout") and row["layout"] == "prompt_response"


@pytest.mark.parametrize("empty", [False, True])
def test_more_families_come_back(spark, empty):
    rng = random.Random(4)
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["system", *["user", "assistant"] * 2], ["user", "assistant", "user"], ["human", "gpt"], ["system"], ["assistant", "user"]]
    rows, want = [], {}
    for i in range(600):
        want[i] = [(r, "".join(rng.choice(["a", "é", "<s>", "\n", "[INST]", "b ", '"'])  for _ in range(rng.randint(0, 5)))) for r in rng.choice(shapes)]
        rows += [(i, k, r, t) for k, (r, t) in enumerate(want[i])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if empty:
        assert C.format_chats(C.heterogeneous_records(C.conversation_turns(df.limit(0)), more=True)).count() == 0
        return
    out = C.format_chats(C.heterogeneous_records(C.conversation_turns(df), more=True)).select("conv_id", "layout", C.read_turns(F.col("formatted")).alias("turns")).collect()
    for r in out:
        assert r["layout"] and pairs(r["turns"]) == want[r["conv_id"]], r
    assert len({r["layout"] for r in out}) >= 18
