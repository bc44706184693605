"""Chat rows against a plain rendering of every prefix, encoded piece by piece."""

import json
import random
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillflow.sources import chat

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def apply(messages, prompt=False, tools=None, thinking=None):
    """The template, message by message."""
    out, listed = "", "" if tools is None else "\n\n# Tools\n" + tools
    quiet = "<think>\n\n</think>\n\n" if thinking is False else ""
    for i, (role, content) in enumerate(messages):
        content = content or ""
        if i == 0 and listed and role != "system":
            out += f"<|im_start|>system\n{listed}<|im_end|>\n"
        if role == "tool":
            if i == 0 or messages[i - 1][0] != "tool":
                out += "<|im_start|>user"
            out += f"\n<tool_response>\n{content}\n</tool_response>"
            if i == len(messages) - 1 or messages[i + 1][0] != "tool":
                out += "<|im_end|>\n"
        else:
            out += f"<|im_start|>{role}\n" + (quiet if role == "assistant" else "") + content + (listed if role == "system" and i == 0 else "") + "<|im_end|>\n"
    return out + ("<|im_start|>assistant\n" + quiet if prompt else "")


def brute(messages, tools=None, thinking=None):
    """Ids and mask by the differences of rendered prefixes."""
    ids, mask, i = [], [], 0
    encode = lambda t: tokenizer().encode(t, add_special_tokens=False).ids
    while i < len(messages):
        j = i + 1
        while messages[i][0] == "tool" and j < len(messages) and messages[j][0] == "tool":
            j += 1
        before, after = apply(messages[:i], tools=tools, thinking=thinking) if i else "", apply(messages[:j], tools=tools, thinking=thinking)
        if messages[i][0] == "assistant":
            head = apply(messages[:i], True, tools, thinking) if i else after[: after.index("<|im_start|>assistant\n") + len("<|im_start|>assistant\n") + (len("<think>\n\n</think>\n\n") if thinking is False else 0)]
            a, b = encode(head[len(before) :]), encode(after[len(head) :])
            ids, mask = ids + a + b, mask + [0] * len(a) + [1] * len(b)
        else:
            a = encode(after[len(before) :])
            ids, mask = ids + a, mask + [0] * len(a)
        i = j
    return ids, mask


CHATS = [
    [("system", "Be brief."), ("user", "2+2?"), ("assistant", "4"), ("user", "And\n3+3? é 漢"), ("assistant", " 6 ")],
    [("user", "weather?"), ("assistant", "I'll look."), ("tool", "rain"), ("tool", ""), ("tool", "wind"), ("assistant", "Rain and wind."), ("tool", "late")],
    [("assistant", "Hello"), ("assistant", None), ("user", "")],
    [("tool", "x"), ("user", "y" * 300)],
    [],
]
SCHEMA = "id int, messages array<struct<role:string,content:string>>, tools string, thinking boolean"
TOOLS = json.dumps([{"name": "f"}])


def cases():
    return [(n, m, t, k) for n, (m, t, k) in enumerate((m, t, k) for m in CHATS for t in (None, TOOLS) for k in (None, True, False))]


def test_ids_and_masks_equal_brute_force(spark):
    rows = spark.createDataFrame(cases(), SCHEMA).repartition(3)
    made = chat.pieces(F.col("messages"), None, F.col("tools"), F.col("thinking"))
    got = {r.id: r for r in rows.select("id", chat.text_of(made).alias("text"), chat.spans_of(made).alias("spans"), chat.tokens(made, PATH).alias("t")).collect()}
    for n, messages, tools, thinking in cases():
        text = apply(messages, False, tools, thinking)
        ids, mask = brute(messages, tools, thinking)
        assert got[n].text == text and (got[n].t.ids, got[n].t.learn) == (ids, mask)
        assert "".join(text[s.start : s.end] for s in got[n].spans) == text
        assert got[n].t.seams == len(tokenizer().encode(text, add_special_tokens=False).ids) - len(ids)


@pytest.mark.parametrize(("most", "truncation"), [(400, "error"), (20, "left"), (20, "right"), (1, "middle"), (21, "middle")])
def test_rows_are_padded_and_cut(spark, most, truncation):
    rows = spark.createDataFrame([c for c in cases() if c[0] < 6 or truncation != "error"], SCHEMA)
    out = chat.sft_rows(rows, "messages", PATH, most, truncation, 7, tools="tools", thinking="thinking").collect()
    for r in out:
        ids, mask = brute([tuple(m) for m in r.messages], r.tools, r.thinking)
        cut = {"left": lambda x: x[-most:], "right": lambda x: x[:most], "error": lambda x: x, "middle": lambda x: x if len(x) <= most else x[: most // 2] + x[len(x) - (most - most // 2) :]}[truncation]
        n = len(cut(ids))
        assert r.fault is None and r.n_tokens == len(ids)
        assert r.ids == cut(ids) + [7] * (most - n) and r.learn == cut(mask) + [0] * (most - n)
        assert r.attention == [1] * n + [0] * (most - n) and r.positions == list(range(n)) + [0] * (most - n)


def test_too_long_fails(spark):
    rows = spark.createDataFrame(cases()[:1], SCHEMA)
    with pytest.raises(Exception, match="longer than the limit"):
        chat.sft_rows(rows, "messages", PATH, 5).collect()
    with pytest.raises(ValueError, match="unknown truncation"):
        chat.sft_rows(rows, "messages", PATH, 5, "inside")


def test_faults(spark):
    rows = spark.createDataFrame([(0, [("user", "a"), ("system", "b")]), (1, [("robot", "a")]), (2, [(None, "a")]), (3, None), (4, [("system", "a"), ("user", "b")])], "id int, m array<struct<role:string,content:string>>")
    got = {r.id: r for r in chat.sft_rows(rows, "m", PATH, 60).collect()}
    assert [got[i].fault for i in range(5)] == ["system message is not first", "unknown role robot", "unknown role null", "no messages", None]
    assert [got[i].ids is None and got[i].learn is None and got[i].attention is None and got[i].positions is None for i in range(5)] == [True] * 4 + [False]
    assert chat.sft_rows(rows.limit(0), "m", PATH, 30).count() == 0


def test_prompts_end_with_a_head(spark):
    rows = spark.createDataFrame([c for c in cases() if c[2] is None and c[3] is None], SCHEMA)
    out = chat.prompt_rows(rows, "messages", PATH, 40, "left").collect()
    for r in out:
        text = apply([tuple(m) for m in r.messages], True)
        ids = tokenizer().encode(text, add_special_tokens=False).ids
        n = min(40, len(ids))
        assert r.full_prompt == text and r.raw_ids == ids[-40:] and r.ids == [0] * (40 - n) + ids[-40:]
        assert r.attention == [0] * (40 - n) + [1] * n and r.positions == [0] * (40 - n) + list(range(n))
    assert chat.prompt_rows(rows, "messages", PATH, 40, keep_longer=False).count() == sum(len(tokenizer().encode(apply(m, True), add_special_tokens=False).ids) <= 40 for m in CHATS)


def test_the_tokenizer_sees_few_texts_at_once():
    class Seen:
        most = calls = 0

        def encode_batch(self, texts, add_special_tokens):
            self.most, self.calls = max(self.most, sum(map(len, texts))), self.calls + 1
            return [type("E", (), {"ids": [len(x)]}) for x in texts]

    seen, texts = Seen(), ["x" * n for n in (5, 0, chat.CHARACTERS + 9, *[1000] * 900)]
    assert [x.tolist() for x in chat._ids(seen, texts)] == [[len(x)] for x in texts]
    assert seen.most == chat.CHARACTERS + 9 and seen.calls == 6 and not list(chat._ids(seen, []))


def test_long_texts_are_tokenized_in_parts(monkeypatch):
    """The tokenizer sees no long text whole, and the ids are the same, wherever spaces and line ends stand."""
    rng, seen = random.Random(3), []
    texts = ["".join(rng.choice(["a", "'s", "Ab", " ", "  ", "\n", "\n \n", "\t", "\x1c", "\u3000", "7", "42", ".", "<|", "<|endoftext|>", "漢字", "é", "e\u0301", "🙂", "ſ"]) for _ in range(n)) for n in (0, 3, 400, 900, 5000)]
    want = [tokenizer().encode(x, add_special_tokens=False).ids for x in texts]
    real = chat._ids
    monkeypatch.setattr(chat, "CHARACTERS", 50)
    monkeypatch.setattr(chat, "_ids", lambda t, parts: real(t, seen.extend(map(len, parts)) or parts))
    assert [x.tolist() for x in chat._ids_of_any(tokenizer(), texts)] == want
    assert max(seen) < 200 and sum(seen) == sum(map(len, texts))
    assert chat._cut(tokenizer(), "x" * 99) == ["x" * 99]


def test_ids_are_handed_back_a_few_conversations_at_a_time(spark, monkeypatch):
    """No batch is held as objects or as one result, whatever lies in it, and a slice of an array counts from its own start."""
    rows = [[("x" * n, False, False)] * k for n, k in ((10, 1), (300, 2), (10, 0), (20, 4), (21, 1), (99, 1))] + [None] + [[("", True, False)]] * 150
    column = pa.array([r and [dict(zip(("text", "learn", "glue"), p, strict=True)) for p in r] for r in rows], pa.list_(pa.struct([("text", pa.string()), ("learn", pa.bool_()), ("glue", pa.bool_())])))
    monkeypatch.setattr(chat, "CHARACTERS", 100)
    for whole in (column, column.slice(1), column.slice(3, 9), column.slice(0, 0)):
        parts = list(chat._few(whole))
        assert pa.concat_arrays(parts or [whole]).equals(whole)
        assert all(len(p) <= chat.ROWS and (len(p) == 1 or sum(len(x["text"]) for r in p.to_pylist() for x in r or ()) <= 100) for p in parts)
    frame = spark.range(1000, numPartitions=1).select(F.array(F.struct(F.format_string("word %d", "id").alias("text"), F.lit(False).alias("learn"), F.lit(False).alias("glue"))).alias("p"))
    got = frame.select("p", chat.tokens(F.col("p"), PATH).alias("t")).collect()
    assert [r.t.ids for r in got] == [tokenizer().encode(r.p[0].text, add_special_tokens=False).ids for r in got] and all(r.t.seams == 0 for r in got)
