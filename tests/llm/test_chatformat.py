import json
import random

from pyspark.sql import functions as F

from corpusloom.llm import chatformat as C

PARTS = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "|im_start|>", "|im_end|>", "\n", "a", " ", "%", "0A", "25", "é", "</s>", "[INST]", "<\\s>", "|>"]


def formatted(spark, records):
    df = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, (str, type(None))) else r) for i, r in enumerate(records)], "id int, record string")
    return C.format_chats(df)


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(6)
    chats = [[(rng.choice(["user", "assistant", "a<s>", "x\ny", "%0A"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))) for _ in range(rng.randint(1, 5))] for _ in range(400)]
    out = formatted(spark, [{"messages": [{"role": r, "content": t} for r, t in c]} for c in chats])
    rows = out.select("id", "formatted", "loss_spans", C.read_turns(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in rows:
        chat = chats[r["id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == chat
        assert r["loss"] == "".join(t for role, t in chat if role == "assistant")
        plain = r["formatted"].replace(C.START, "").replace(C.END, "")
        assert not any(c in plain for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>"))


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "more": 1}], "id": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "with this", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "response": "a", "system": "s"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"messages": [{"role": "user", "content": None}]},
        {"something": "else"},
        "not json",
        None,
        {"messages": []},
    ]
    got = {r["id"]: r for r in formatted(spark, records).select("id", "layout", C.read_turns(F.col("formatted")).alias("turns")).collect()}
    pairs = lambda i: [(t["role"], t["text"]) for t in got[i]["turns"]]
    plain = [("user", "q"), ("assistant", "a")]
    assert [pairs(i) for i in (0, 1, 2, 3, 5, 7, 8)] == [plain] * 7
    assert pairs(4) == [("user", "q\n\nwith this"), ("assistant", "a")]
    assert pairs(6) == [("system", "s"), *plain]
    assert [got[i]["layout"] for i in (0, 1, 2, 3, 7, 8)] == ["messages", "from_value", "role_text", "instruction", "prompt_completion", "question_answer"]
    assert [got[i]["layout"] for i in (10, 11, 12, 13)] == [None] * 4 and got[11]["turns"] is None


def test_records_of_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "n"), (2, None, None, None), (2, 0, "user", "é" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: json.loads(r["record"])["messages"] for r in C.conversation_records(df).collect()}
    assert got[1] == [{"role": "user", "content": "a"}] + [{"role": "assistant", "content": "b"}] * 2
    assert got[None] == [{"role": "user", "content": "n"}]
    assert got[2][0] == {"role": "", "content": ""} and len(got[2][1]["content"]) == 100_000
    assert C.conversation_records(df.limit(0)).count() == 0


def test_mixed_layouts_keep_all_turns(spark):
    plain = [("user", "q"), ("assistant", "a")]
    cases = [
        ({"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("system", "s"), *plain]),
        ({"system": "s", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]}, [("system", "s"), ("user", "q")]),
        ({"prompt": "q", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, plain),
        ({"prompt": "p", "messages": [{"role": "assistant", "content": "a"}]}, [("user", "p"), ("assistant", "a")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "s"), *plain]),
        ({"question": "q", "answer": "a", "input": "with"}, [("user", "q\n\nwith"), ("assistant", "a")]),
        ({"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, [("user", ""), ("assistant", "a")]),
        ({"conversations": [{"role": "human", "content": "q"}, {"from": "gpt", "value": "a"}]}, [("human", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]}, [("user", "q\nr")]),
        ({"prompt": "q", "answer": "a", "system_prompt": "s", "meta": {"id": 1, "tags": ["x", 2, None]}}, [("system", "s"), *plain]),
        ({"instruction": "q", "output": None}, [("user", "q"), ("assistant", "")]),
        ('{"prompt": "p", "prompt": "q", "response": "a"}', plain),
    ]
    got = {r["id"]: r for r in formatted(spark, [c for c, _ in cases]).select("id", "layout", C.read_turns(F.col("formatted")).alias("turns")).collect()}
    for i, (_, want) in enumerate(cases):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == want, cases[i]


def test_paths_and_fingerprints(spark):
    records = ['{"b": [{"x": 1}, {"y": {"z": null}}], "a": 1.5, "o": {}, "e": [], "odd `name: <": {"k": [[1]]}}', '{"a": 2, "o": {}, "e": [], "b": [{"y": {"z": "t"}}, {"x": 0}], "odd `name: <": {"k": [[true]]}}', "[1]", "5", "no", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, record string")
    got = [r["p"] for r in df.select("id", C.field_paths(F.try_parse_json("record")).alias("p")).orderBy("id").collect()]
    want = ["a", "b", "b[]", "b[].x", "b[].y", "b[].y.z", "e", "e[]", "o"]
    odd = [p for p in got[0] if p.startswith("`")]
    assert [p for p in got[0] if p not in odd] == want and got[0] == got[1] and len(odd) == 4
    assert got[2:] == [["[]"], [], None, None]
    prints = [r["fingerprint"] for r in C.format_chats(df).orderBy("id").select("fingerprint").collect()]
    assert prints[0] == prints[1] is not None and prints[3:] == [None] * 3


def test_all_layouts_have_other_paths():
    assert len({x.paths for x in C.LAYOUTS}) == len({x.name for x in C.LAYOUTS}) == len(C.LAYOUTS)


def test_heterogeneous_records_come_back(spark):
    rng = random.Random(2)
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["human", "gpt"], ["system"], ["system", "user", "system"], ["assistant", "user"], ["", "user"]]
    rows, want = [], {}
    for i in range(300):
        roles = rng.choice(shapes)
        want[i] = [(r, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))) for r in roles]
        rows += [(i, k, r, t) for k, (r, t) in enumerate(want[i])]
    chats = C.conversation_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = C.format_chats(C.heterogeneous_records(chats)).select("conv_id", "layout", C.read_turns(F.col("formatted")).alias("turns")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == want
    assert {r["layout"] for r in out} == {"messages", "from_value", "role_text", "conversations_role_content", "instruction", "prompt_response", "prompt_completion", "question_answer"}


def test_records_beyond_the_variant_limits(spark):
    """20,000,000 characters are the most that a string of a variant has; longer ones take the other way."""
    record = F.to_json(F.struct(F.repeat(F.lit("x"), (F.col("id") + 20_000_000).cast("int")).alias("prompt"), F.lit("a").alias("response"))).alias("record")
    at, over = spark.range(1).select(record), spark.range(1, 2).select(record)
    assert [r[0] for r in at.unionByName(over).select(F.try_parse_json("record").isNull()).collect()] == [False, True]
    got = C.format_chats(at.unionByName(over)).select("layout", F.length("formatted").alias("n")).collect()
    assert [r["layout"] for r in got] == ["prompt_response"] * 2 and got[1]["n"] == got[0]["n"] + 1


def test_clashing_columns_repeats_and_empty_table(spark):
    record = json.dumps({"prompt": "q", "response": "a"})
    df = spark.createDataFrame([(1, record, "mine", "old", "old")] * 2, "id int, record string, turns string, layout string, formatted string")
    out = C.format_chats(df)
    assert out.columns == ["id", "record", "turns", "fingerprint", "layout", "formatted", "loss_spans"]
    assert [(r["turns"], r["layout"]) for r in out.collect()] == [("mine", "prompt_response")] * 2
    assert C.format_chats(df.limit(0)).count() == 0


def test_turns_are_formatted_as_their_records(spark):
    small = spark.createDataFrame([(1, 1, "assistant", "</s>b"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "a\nb", "n")], "conv_id long, turn long, role string, text string")
    by_json = C.format_chats(C.conversation_records(small)).select("conv_id", "formatted", "loss_spans").collect()
    assert sorted(map(str, C.format_turns(C.conversation_turns(small)).select("conv_id", "formatted", "loss_spans").collect())) == sorted(map(str, by_json))


def test_query_formats_a_conversation_beyond_the_json_limit(spark, tmp_path):
    """One text of more than 20,000,000 characters is no variant."""
    from corpusloom.llm.queries import op9_chat_formatting

    rows = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") < 1, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("x"), F.when(F.col("id") < 1, 3).otherwise(21_000_000)).alias("text"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, 21_000_000) and got[-7]["n_turns"] == 2
