"""Chat rows for training: messages rendered by a template, tokenized, and masked token by token.

A template is rendered as pieces, an array of (text, learn, glue) built by column expressions: the text of a conversation
is its pieces end to end, ``learn`` marks what the assistant said, and a glued piece is tokenized with the one before.
Tokenizing is the only Python: pieces of a batch go through the tokenizer some hundred kilobytes at a time. Lengths, padding, truncation and
positions are column expressions again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Conversations held as Python objects and handed back at once, and characters tokenized at once.
ROWS, CHARACTERS = 64, 1 << 18
ROLES = ("system", "user", "assistant", "tool")
PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("learn", T.BooleanType()), T.StructField("glue", T.BooleanType())]))
TOKENS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("learn", T.ArrayType(T.IntegerType())), T.StructField("seams", T.IntegerType())])


@dataclass(frozen=True)
class Template:
    """``open`` and ``close`` stand around a message, with ``{role}`` for its role. Tool results stand in a user's message, several in a row in one.
    ``no_thoughts`` follows the head of an assistant's message where thinking is off; ``tools`` introduces the tools after the system's text."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    tool_open: str = "\n<tool_response>\n"
    tool_close: str = "\n</tool_response>"
    no_thoughts: str = "<think>\n\n</think>\n\n"
    tools: str = "\n\n# Tools\n"

    def head(self, role: str) -> str:
        return self.open.format(role=role)


def faults(messages: Column) -> Column:
    """What keeps a conversation from being rendered, or null: a role that isn't known, or a system message that isn't first."""
    unknown = F.filter(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    late = F.exists(F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1))), lambda m: m["role"] == "system")
    return F.when(messages.isNull(), "no messages").when(F.size(unknown) > 0, F.concat(F.lit("unknown role "), F.coalesce(F.element_at(unknown, 1)["role"], F.lit("null")))).when(late, "system message is not first")


def pieces(messages: Column, template: Template | None = None, tools: Column | None = None, thinking: Column | None = None, prompt: bool = False) -> Column:
    """The pieces of ``messages`` (array of role, content; a null content is empty). ``tools``: JSON text, or null. ``thinking``: false where it is off;
    null and true leave the template as it is. ``prompt`` ends with the head of an assistant's message to be written."""
    t = template or Template()
    lit, no = F.lit, F.lit(False)
    piece = lambda text, learn=no, glue=no: F.struct(text.alias("text"), learn.alias("learn"), glue.alias("glue"))
    off = F.when(~thinking, t.no_thoughts).otherwise("") if thinking is not None else lit("")
    listed = F.when(tools.isNotNull(), F.concat(lit(t.tools), tools)).otherwise("") if tools is not None else lit("")
    assistant = F.concat(lit(t.head("assistant")), off)
    role_at = lambda i: F.get(messages, i)["role"]

    def rendered(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], lit(""))
        # Tools without a system message get one of their own before the first.
        own = F.when((i == 0) & (listed != ""), F.concat(lit(t.head("system")), listed, lit(t.close))).otherwise("")
        result = F.concat(
            F.when(F.coalesce(role_at(i - 1) == "tool", no), "").otherwise(t.head("user").rstrip("\n")), lit(t.tool_open), content, lit(t.tool_close),
            F.when(F.coalesce(role_at(i + 1) == "tool", no), "").otherwise(t.close),
        )
        return (
            F.when(m["role"] == "assistant", F.array(piece(F.concat(own, assistant)), piece(F.concat(content, lit(t.close)), lit(True))))
            .when(m["role"] == "tool", F.array(piece(F.concat(own, result), no, F.coalesce(role_at(i - 1) == "tool", no))))
            .when(m["role"] == "system", F.array(piece(F.concat(lit(t.head("system")), content, F.when(i == 0, listed).otherwise(""), lit(t.close)))))
            .otherwise(F.array(piece(F.concat(own, F.replace(lit(t.open), lit("{role}"), m["role"]), content, lit(t.close)))))
        )

    out = F.flatten(F.transform(messages, rendered))
    return F.concat(out, F.array(piece(assistant))) if prompt else out


def text_of(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def spans_of(pieces: Column) -> Column:
    """(start, end, learn) of each piece in the text, in characters. One fold over the pieces' lengths."""
    ends = F.transform(pieces, lambda p, i: F.struct(F.length(p["text"]).alias("n"), p["learn"].alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,learn:boolean>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + p["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + p["n"]).alias("end"), p["learn"].alias("learn")))).alias("out"))
    return F.aggregate(ends, start, step)["out"]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(tokenizer, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text. What the tokenizer makes of a text takes some hundred bytes a token, so it sees ``CHARACTERS`` at once, or one longer text."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= CHARACTERS:
            size += len(texts[j])
            j += 1
        yield from [np.array(e.ids, np.int32) for e in tokenizer.encode_batch(texts[i:j], add_special_tokens=False)]
        i = j


@lru_cache(maxsize=4)
def _starts_words_at_spaces(tokenizer) -> bool:
    """Whether a word of the tokenizer always begins at a space or line end after anything else, as GPT-2's do."""
    from tokenizers.pre_tokenizers import ByteLevel

    by = tokenizer.pre_tokenizer
    plain = isinstance(by, ByteLevel) and by.use_regex and not by.add_prefix_space and tokenizer.normalizer is None and tokenizer.truncation is None and tokenizer.padding is None
    return plain and not any(t.lstrip or t.rstrip or t.single_word or re.search("[ \n]", t.content) for t in tokenizer.get_added_tokens_decoder().values())


def _cut(tokenizer, text: str) -> list[str]:
    """``text`` in parts of about ``CHARACTERS`` whose ids end to end are its own: the tokenizer takes hundreds of bytes a character. Where it has no such places, whole."""
    if len(text) <= CHARACTERS or not _starts_words_at_spaces(tokenizer):
        return [text]
    out, i, place = [], 0, re.compile(r"(?<=\S)[ \n]")
    while len(text) - i > CHARACTERS and (m := place.search(text, i + CHARACTERS)):
        out.append(text[i : m.start()])
        i = m.start()
    return [*out, text[i:]]


def _ids_of_any(tokenizer, texts: list[str]) -> list[np.ndarray]:
    """``_ids`` of texts of any length."""
    parts = [_cut(tokenizer, x) for x in texts]
    ids = _ids(tokenizer, [p for x in parts for p in x])
    return [np.concatenate([next(ids) for _ in x]) if len(x) > 1 else next(ids) for x in parts]


def _few(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of pieces of ``ROWS`` conversations, of fewer if these have over ``CHARACTERS`` bytes; a longer conversation comes alone."""
    size = pc.fill_null(pc.binary_length(column.values.field("text")), 0).to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[column.offsets.to_numpy()]
    i = 0
    while i < len(column):
        j = int(np.searchsorted(begins, begins[i] + CHARACTERS, "right")) - 1
        j = min(max(j, i + 1), i + ROWS, len(column))
        yield column.slice(i, j - i)
        i = j


def tokens(pieces: Column, tokenizer: str) -> Column:
    """(ids, learn, seams) of pieces, by the tokenizer in a file that every executor has: the tokens of each piece (glued ones in one) end to end, 1 where
    they are to be learnt, and how many ids of the whole text differ in number from these; 0 of both nearly always means the same ids. Null stays null."""

    def part(rows: list) -> pa.Array:
        t = _tokenizer(tokenizer)
        texts, learn, owner = [], [], []
        for i, row in enumerate(rows):
            for k, p in enumerate(row or ()):
                if p["glue"] and k:
                    texts[-1] += p["text"] or ""
                else:
                    texts.append(p["text"] or "")
                    learn.append(bool(p["learn"]))
                    owner.append(i)
        ids = _ids_of_any(t, texts)
        many = np.array([len(x) for x in ids], np.int64)
        size = np.bincount(np.array(owner, np.int64), many, len(rows)).astype(np.int64) if owner else np.zeros(len(rows), np.int64)
        # One text is the whole text already.
        whole, several = size.copy(), np.flatnonzero(np.bincount(np.array(owner, np.int64), minlength=len(rows)) > 1)
        whole[several] = [len(x) for x in _ids_of_any(t, ["".join(p["text"] or "" for p in rows[i]) for i in several])]
        at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        gone = pa.array([row is None for row in rows], pa.bool_())
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        lists = [pa.ListArray.from_arrays(at, flat), pa.ListArray.from_arrays(at, pa.array(np.repeat(np.array(learn, np.int32), many) if len(many) else np.zeros(0, np.int32)))]
        return pa.StructArray.from_arrays([*lists, pa.array(whole - size, pa.int32())], names=["ids", "learn", "seams"], mask=gone)

    @F.arrow_udf(TOKENS)
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from (part(some.to_pylist()) for some in _few(column))

    return encode(pieces)


def shortened(items: Column, most: int, truncation: str) -> Column:
    """At most ``most`` items: of longer arrays the last (``left``), the first (``right``), half of both ends (``middle``: the odd one at the end), or an ``error``."""
    cuts = {
        "left": lambda: F.slice(items, -most, most), "right": lambda: F.slice(items, 1, most),
        "middle": lambda: F.concat(F.slice(items, 1, most // 2), F.slice(items, -(most - most // 2), most - most // 2)),
        "error": lambda: F.raise_error(F.concat(F.lit("longer than the limit: "), F.size(items).cast("string"))).cast("array<int>"),
    }
    if truncation not in cuts:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(items.isNull() | (F.size(items) <= most), items).otherwise(cuts[truncation]())


def padded(rows: DataFrame, ids: str, most: int, pad: int = 0, truncation: str = "error", left: bool = False, masks: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``ids`` and ``masks`` of exactly ``most`` items, ``attention`` and ``positions``: padding counts as 0 in masks, attention and positions."""
    size = F.least(F.size(ids), F.lit(most))
    fill = lambda c, by: F.concat(F.array_repeat(F.lit(by), most - size), c) if left else F.concat(c, F.array_repeat(F.lit(by), most - size))
    columns = {ids: fill(shortened(F.col(ids), most, truncation), pad)} | {m: fill(shortened(F.col(m), most, truncation), 0) for m in masks}
    attention = fill(F.array_repeat(F.lit(1), size), 0)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when((i >= most - size) if left else (i < size), i - (most - size if left else 0)).otherwise(0).cast("int"))
    # Names within lambdas would mean the new ids, so these come first.
    return rows.withColumns({"attention": attention, "positions": places}).withColumns(columns)


def sft_rows(rows: DataFrame, messages: str, tokenizer: str, most: int, truncation: str = "error", pad: int = 0, template: Template | None = None, tools: str | None = None, thinking: str | None = None) -> DataFrame:
    """``rows`` with ``ids``, ``learn``, ``attention``, ``positions`` of ``most`` items, ``n_tokens`` before that, ``seams`` and ``fault``.

    A conversation with a fault has null arrays; one that is too long is cut as ``truncation`` says, or fails the job. Padding is on the right.
    """
    fault = faults(F.col(messages))
    made = pieces(F.col(messages), template, F.col(tools) if tools else None, F.col(thinking) if thinking else None)
    out = rows.withColumn("fault", fault).withColumn("_t", tokens(F.when(fault.isNull(), made), tokenizer))
    out = out.withColumns({"ids": F.col("_t.ids"), "learn": F.col("_t.learn"), "seams": F.col("_t.seams"), "n_tokens": F.when(F.col("_t").isNotNull(), F.size("_t.ids"))}).drop("_t")
    made = padded(out, "ids", most, pad, truncation, masks=("learn",))
    gone = lambda c: F.when(F.col("fault").isNull(), F.col(c)).alias(c)
    return made.select(*[gone(c) if c in ("ids", "learn", "attention", "positions") else F.col(f"`{c}`") for c in made.columns])


def prompt_rows(rows: DataFrame, messages: str, tokenizer: str, most: int, truncation: str = "error", pad: int = 0, template: Template | None = None, keep_longer: bool = True) -> DataFrame:
    """``rows`` with the prompt's ``full_prompt``, ``raw_ids`` (shortened), ``ids`` padded on the left, ``attention`` and ``positions``. Without ``keep_longer``, prompts of over ``most`` tokens go."""
    made = pieces(F.col(messages), template, prompt=True)
    out = rows.withColumn("full_prompt", text_of(made)).withColumn("_t", tokens(F.array(F.struct(F.col("full_prompt").alias("text"), F.lit(False).alias("learn"), F.lit(False).alias("glue"))), tokenizer))
    out = out.withColumn("ids", F.col("_t.ids")).drop("_t")
    out = out if keep_longer else out.where(F.size("ids") <= most)
    return padded(out.withColumn("raw_ids", shortened(F.col("ids"), most, truncation)), "ids", most, pad, truncation, left=True)
