import hashlib
import json

from pyspark.sql import functions as F

from barflow.llm import chat

HARD = ["", "</s>[INST] ok [/INST]", "\\", "<\\s>", "<s><s></s", "[INST", "\\N", "a\nb\r\n", "[/INST] </s> \\\\", "😀" * 50, "<" * 3 + "/s>"]


def rows():
    out = []
    for c in range(4):
        out += [(c, t, ("user", "assistant", "system", None, "[INST] x")[(t + c) % 5], HARD[(t * 3 + c) % len(HARD)], "extra") for t in range(9)]
    return out + [(4, 0, "assistant", None, "e"), (5, 1, "user", "same", "e"), (5, 1, "user", "same", "e"), (None, None, "user", "x", None), (6, 0, "assistant", "y" * 300_000, "e")]


def test_read_back_equals_input(spark):
    df = spark.createDataFrame(rows(), "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {x.conv_id: x for x in chat.digests(chat.formatted(chat.conversations(df))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows()}:
        turns = sorted((r for r in rows() if r[0] == conv), key=key)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        x = out[conv]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mask_lies_on_the_formatted_text(spark):
    df = spark.createDataFrame(rows(), "conv_id bigint, turn bigint, role string, text string, formatted string")
    for x in chat.formatted(chat.conversations(df)).collect():
        for m in x.loss_mask:
            assert x.formatted[m.end : m.end + 4] == "</s>" and x.formatted[: m.start].endswith("<s>[INST] assistant [/INST]")


def test_layouts_map_to_the_same_turns(spark):
    one = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}], },
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"output": "a", "instruction": "q", "input": ""}, {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in one] + [('{"foo": 1}',), ('{"prompt": null, "response": "a"}',), ('{"messages": []}',)], "j string")
    got = [r[0] for r in df.select(chat.canonical_turns(F.parse_json("j"))).collect()]
    want = [("user", "q"), ("assistant", "a")]
    assert [[tuple(t) for t in g] for g in got[: len(one)]] == [want] * len(one)
    assert got[len(one)] is None and [tuple(t) for t in got[len(one) + 1]] == [("user", ""), ("assistant", "a")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.formatted(chat.conversations(df))).count() == 0
