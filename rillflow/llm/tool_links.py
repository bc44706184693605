"""Chat formatting: tool calls linked to results, ordered, validated and serialised.

All DataFrame expressions. Calls and results meet in a hash join on the conversation and the call's identifier: other
conversations may use the same one. A call's level is one more
than the highest level among the calls it needs: chains of single needs are followed by pointer doubling, calls with
several needs settle round by round; calls on a cycle, or behind one, never settle and are marked. Arguments are parsed once as a
variant, whose objects keep their keys sorted, so that serialising it again is canonical. Nothing is gathered by
conversation: rows carry (conv_id, level, turn), which orders a conversation of any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.tables import cut, shared_dir

BLOCK = r"(?s)<{0}>\s*(\{{.*?\}})\s*</{0}>"


@dataclass(frozen=True)
class Field:
    """An argument: its JSON type (string, integer, number, boolean, array, object), whether it must be there, its least length or value."""

    type: str
    required: bool = True
    least: int | None = None


_VARIANT = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE|DECIMAL.*|BIGINT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def blocks(messages: DataFrame, tag: str, text: str = "text") -> DataFrame:
    """One row for each ``<tag>{json}</tag>`` of a message: conv_id, turn, place and body (the JSON's text)."""
    found = F.expr(f"regexp_extract_all(coalesce(`{text}`, ''), '{BLOCK.format(tag)}', 1)".replace("\\", "\\\\"))
    return messages.select("conv_id", "turn", F.posexplode(found).alias("place", "body"))


def calls_in(messages: DataFrame, text: str = "text") -> DataFrame:
    """(conv_id, turn, call_id, name, arguments, needs) of the ``<tool_call>`` blocks: JSON with id, name, arguments, needs."""
    b = blocks(messages, "tool_call", text)
    get = lambda k: F.get_json_object("body", f"$.{k}")
    needs = F.coalesce(F.from_json(get("needs"), "array<string>"), F.expr("cast(array() as array<string>)"))
    return b.select("conv_id", "turn", get("id").alias("call_id"), get("name").alias("name"), get("arguments").alias("arguments"), needs.alias("needs"))


def results_in(messages: DataFrame, text: str = "text") -> DataFrame:
    """(conv_id, call_id, turn, content) of the ``<tool_result>`` blocks: JSON with id and content."""
    b = blocks(messages, "tool_result", text)
    return b.select("conv_id", F.get_json_object("body", "$.id").alias("call_id"), "turn", F.get_json_object("body", "$.content").alias("content"))


def errors(schemas: Mapping[str, Mapping[str, Field]], name: Column, arguments: Column) -> Column:
    """What is wrong with a call's arguments (JSON text), as an array of strings in a fixed order; empty if valid."""
    v = F.try_parse_json(arguments)
    out = F.when(F.lit(True), F.array(F.lit("unknown tool")))
    for tool, fields in schemas.items():
        checks = [F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object"))]
        for key, field in fields.items():
            value = F.try_variant_get(v, f"$.{key}", "variant")
            absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
            if field.required:
                checks.append(F.when(absent, F.lit(f"{key}: missing")))
            checks.append(F.when(~absent & ~F.schema_of_variant(value).rlike(f"^({_VARIANT[field.type]})$"), F.lit(f"{key}: not {field.type}")))
            if field.least is not None:
                kind = "string" if field.type == "string" else "double"
                got = F.try_variant_get(v, f"$.{key}", kind)
                checks.append(F.when((F.length(got) if kind == "string" else got) < field.least, F.lit(f"{key}: below {field.least}")))
        extra = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*[F.lit(k) for k in fields]))
        checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("extra: "), F.array_join(F.array_sort(extra), ","))))
        out = F.when(name == tool, F.array_compact(F.array(*checks))).otherwise(out)
    return F.when(name.isNull(), F.array(F.lit("unknown tool"))).otherwise(out)


def _jumps(single: DataFrame, calls: int) -> DataFrame:
    """(call_id, anchor, distance, open) of calls with one need: where following single needs ends, by pointer doubling.

    ``open`` stays true for calls that never end: they lead into a cycle."""
    state = cut(single.select("call_id", F.col("need").alias("anchor"), F.lit(1).alias("distance"), F.lit(True).alias("open")), "jumps")
    for _ in range(calls.bit_length() + 1):
        if state.where("open").isEmpty():
            break
        by = state.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("_to"), F.col("distance").alias("_more"))
        moved = state.join(by, "anchor", "left").withColumn("open", F.col("_to").isNotNull())
        state = cut(moved.select("call_id", F.coalesce("_to", "anchor").alias("anchor"), (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance"), "open"), "jumps")
    return state


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of every call with settled needs; needs that no call has count as settled. Roots have level 0.

    Chains of calls with one need each, however long, are followed by doubling. What is left are calls with several
    needs, each leading to a root or to another such call at a known distance: a round settles those whose ends are settled.
    """
    known = calls.select("call_id").where("call_id is not null").distinct()
    needs = calls.where("call_id is not null").select("call_id", F.explode("needs").alias("need")).distinct()
    needs = cut(needs.join(known.withColumnRenamed("call_id", "need"), "need").select("call_id", "need"), "needs")
    many = needs.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))
    single, several = (needs.join(many.where(c), "call_id", "left_semi") for c in ("n = 1", "n > 1"))
    settled = cut(known.join(many, "call_id", "left_anti").withColumn("level", F.lit(0)), "level")
    jumps = _jumps(single, known.count())
    ends = jumps.select(F.col("call_id").alias("need"), F.when(~F.col("open"), F.col("anchor")).otherwise(F.col("call_id")).alias("anchor"), "distance")
    edges = several.join(ends, "need", "left").select("call_id", F.coalesce("anchor", "need").alias("anchor"), (F.coalesce("distance", F.lit(0)) + 1).alias("distance"))
    edges, now = cut(edges.withColumn("level", F.lit(None).cast("int")), "edges"), settled
    spark = calls.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rillflow/{spark.sparkContext.applicationId}/levels-{uuid.uuid4().hex}"
    settled.write.parquet(path)
    # Only what the last round settled meets the edges that are left; all rounds append to one table.
    while not edges.isEmpty():
        met = edges.join(now.select(F.col("call_id").alias("anchor"), F.col("level").alias("_l")), "anchor", "left")
        edges = cut(met.select("call_id", "anchor", "distance", F.coalesce("level", F.col("_l") + F.col("distance")).cast("int").alias("level")), "edges")
        now = edges.groupBy("call_id").agg(F.count_if(F.col("level").isNull()).alias("left"), F.max("level").alias("level")).where("left = 0")
        now = cut(now.select("call_id", "level"), "level")
        if now.isEmpty():
            break
        now.write.mode("append").parquet(path)
        edges = edges.join(now.select("call_id"), "call_id", "left_anti")
    settled = spark.read.schema(settled.schema).parquet(path)
    ended = jumps.where("not open").join(settled.withColumnRenamed("call_id", "anchor"), "anchor")
    return settled.unionAll(ended.select("call_id", (F.col("level") + F.col("distance")).cast("int").alias("level")))


def _key(call_id: Column | str) -> Column:
    """A call's identifier within its conversation."""
    return F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), (F.col(call_id) if isinstance(call_id, str) else call_id).alias("i")))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Field]]) -> DataFrame:
    """One row for each call: conv_id, turn, call_id, name, level, result_turn, errors (comma-joined), valid and json.

    ``json``: the call with its result as canonical JSON, keys sorted, no spaces; null results and unparsed arguments
    are left out. An identifier holds within its conversation (calls without conv_id are one). Of several results with
    one identifier the least (turn, then content) counts; of several calls the least (turn, name, arguments), and the
    others are kept with the error ``duplicate``, no result and level 0. A call without identifier meets no result and
    has level 0; one on a cycle has a null level and the error ``cycle``. Null needs are none. An empty table gives
    none; other columns are ignored.
    """
    given = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("needs", F.expr("cast(array() as array<string>)")).alias("needs"))
    given = cut(given.withColumn("_k", F.when(F.col("call_id").isNotNull(), _key("call_id"))).withColumn("_row", F.monotonically_increasing_id()), "calls")
    first = given.where("_k is not null").groupBy("_k").agg(F.min(F.struct("turn", "name", "arguments", "_row")).alias("b"), F.count(F.lit(1)).alias("n"))
    named = given.join(first.select(F.col("_k").alias("_f"), F.col("b._row").alias("_row")), "_row").drop("_f")
    again = given.join(first.where("n > 1").select("_k", F.col("b._row").alias("_least")), "_k").where("_row != _least").drop("_least").select(*given.columns)
    answers = results.where("call_id is not null").select(_key("call_id").alias("_k"), "turn", "content").groupBy("_k").agg(F.min(F.struct("turn", "content")).alias("r")).select("_k", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))
    known = named.select(F.col("_k").alias("call_id"), F.transform("needs", _key).alias("needs"))
    joined = named.join(levels(known).withColumnRenamed("call_id", "_k"), "_k", "left").join(answers, "_k", "left").withColumn("_double", F.lit(False))
    none = {"level": F.lit(0), "result_turn": F.lit(None).cast("long"), "result": F.lit(None).cast("string")}
    rows = joined.unionByName(given.where("_k is null").withColumns({**none, "_double": F.lit(False)})).unionByName(again.withColumns({**none, "_double": F.lit(True)}))
    marks = F.array_compact(F.array(F.when(F.col("level").isNull(), F.lit("cycle")), F.when(F.col("_double"), F.lit("duplicate"))))
    wrong = F.concat(errors(schemas, F.col("name"), F.col("arguments")), marks)
    rows = rows.withColumn("errors", F.array_join(wrong, ", ")).withColumn("valid", F.col("errors") == "")
    canonical = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "name", F.array_sort("needs").alias("needs"), "result", "valid"))
    return rows.select("conv_id", "turn", "call_id", "name", "level", "result_turn", "errors", "valid", canonical.alias("json"))


def turns_as_tools(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's message is a call, the assistant's message in the next turn its result.

    A call needs the call two turns before, if there is one: the exchange it goes on from. A user's message
    without conv_id or turn is a call without identifier or needs; such an assistant's message is no call's result.
    """
    call_id = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    query = F.coalesce("text", F.lit(""))
    n = F.size(F.array_remove(F.split(query, r"[\x20\x09-\x0D]+"), "")).cast("long")
    name = F.when(n <= 12, "search").otherwise("answer")
    arguments = F.to_json(F.struct(query.alias("query"), n.alias("n_words")))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    needs = F.when(placed, F.array(call_id(F.col("turn") - 2))).otherwise(F.expr("cast(array() as array<string>)"))
    calls = messages.where("role = 'user'").select("conv_id", "turn", F.when(placed, call_id(F.col("turn"))).alias("call_id"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = messages.where(placed).where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
