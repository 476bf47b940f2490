"""op5: exact round trips, loss masks, and canonical turns from every layout."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import chat

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\", "\\\\<|", "<\\|x|\\>", "<|<|>|>", "<", "|>", "end <", "é😀\n\n日本\\n", "[INST", "<<SYS>> x <</SYS>>", "<|nl|>", "a\nb\n", "<|im_end|", "\\<s>"]


def test_round_trip(spark):
    rows = [(i % 4, i, role, t) for i, t in enumerate(TEXTS) for role in ("user", "assistant")] + [(9, 0, None, None), (9, 1, "odd\nrole<|im_end|>\n", "x"), (None, 1, "user", "null id"), (9, None, "system", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(turns)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    digests = {r.conv_id: r for r in chat.digest(out).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(b, c) for _, b, c in own]
        said = "".join(f"{b}\n{c}\n" for _, b, c in own)
        learned = "".join(c for _, b, c in own if b == "assistant")
        d = digests[conv]
        assert (d.n_turns, d.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert d.formatted_chars == len(got[conv].formatted)
        body = got[conv].formatted.replace(chat.START, "").replace(chat.END, "").replace(chat.LINE, "")
        assert not any(c in body for c in chat.CONTROLS)
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    tables = [
        spark.createDataFrame([(1, "q", "a", "kept out")], "id long, prompt string, completion string, source string"),
        spark.createDataFrame([(1, "q", "a")], "id long, prompt string, response string"),
        spark.createDataFrame([(1, "q", "", "a")], "id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "id long, turn long, role string, text string"),
    ]
    extra = {n: F.lit("x") for n in ("input", "prompt", "system")}
    tables += [tables[5].withColumns(extra), tables[3].withColumns({"output": F.lit(1), "prompt": F.lit("x")})]
    for t in tables:
        got = chat.canonical(t, "id").orderBy("turn").collect()
        assert [(r.conv_id, r.role, r.text) for r in got] == [(1, *x) for x in turns]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "q")], "id long, prompt string"), "id")


def test_json_records(spark):
    records = [
        {"prompt": "q", "completion": "a"}, {"completion": "a", "prompt": "q", "id": 4}, {"instruction": "q", "input": "more", "output": "a"}, {"system": "s", "instruction": "q", "input": None, "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"unknown": 1},
    ]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, None), (51, "not json")], "id long, record string")
    got, names = {}, {}
    for r in chat.canonical_json(table, "id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        names[r.conv_id] = r.mapping
    pair = [("user", "q"), ("assistant", "a")]
    assert got == {0: pair, 1: pair, 2: [("user", "q\n\nmore"), ("assistant", "a")], 3: [("system", "s"), *pair], 4: pair, 5: pair, 6: [("record", '{"unknown": 1}')], 50: [("record", None)], 51: [("record", "not json")]}
    assert names == {0: "prompt", 1: "prompt", 2: "instruction", 3: "instruction_system", 4: "messages", 5: "conversations", 6: None, 50: None, 51: None}


def test_fingerprints_ignore_order():
    assert chat.fingerprint(["b", "a[].x"]) == chat.fingerprint(["a[].x", "b"]) != chat.fingerprint(["a.x", "b"])
