"""Prompt, preference and multi-turn datasets: readers, canonical rows, masks and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MESSAGE = "struct<role:string,content:string>"


def read_prompts(spark: SparkSession, paths: Sequence[str], tokens: str | None = None, most_tokens: int | None = None) -> DataFrame:
    """Parquet files as one table, without prompts of more than ``most_tokens``."""
    rows = spark.read.parquet(*paths)
    return rows.where(F.size(tokens) <= most_tokens) if tokens and most_tokens is not None else rows


def read_pairs(spark: SparkSession, paths: Sequence[str], prompt: str = "prompt", response: str = "response") -> DataFrame:
    """(prompt, response, prefix) from columns or nested fields; no prefix column counts as null."""
    rows = spark.read.parquet(*paths)
    return rows.select(F.col(prompt).alias("prompt"), F.col(response).alias("response"), (F.col("prefix") if "prefix" in rows.columns else F.lit(None).cast("string")).alias("prefix"))


def canonical(rows: DataFrame, data_source: Column, prompt: Column, ability: Column, truth: Column, split: str, index: Column, **extra: Column) -> DataFrame:
    """The five fields of a prompt row: data_source, prompt (one user message), ability, reward_model and extra_info."""
    return rows.select(
        data_source.alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"), ability.alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), *[c.alias(n) for n, c in extra.items()]).alias("extra_info"),
    )


def with_defaults(rows: DataFrame) -> DataFrame:
    """``index`` and tool arguments lifted out of extra_info; absent ones get 0 and an empty object."""
    fields = rows.schema["extra_info"].dataType.fieldNames()
    get = lambda n, d: F.coalesce(F.col(f"extra_info.{n}").cast("string"), F.lit(d)) if n in fields else F.lit(d)
    return rows.withColumns({"index": get("index", "0").cast("long"), "tools_kwargs": get("tools_kwargs", "{}"), "interaction_kwargs": get("interaction_kwargs", "{}")})


def messages_of(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, messages) in order of turns."""
    packed = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct(turn, "role", F.col("text").alias("content")))).alias("m"))
    return packed.select(conversation, F.transform("m", lambda x: F.struct(x.getField("role").alias("role"), x.getField("content").alias("content"))).alias("messages"))


def loss_mask(role: Column) -> Column:
    """1 on the assistant's messages; an unknown role is an error."""
    known = role.isin("system", "user", "assistant", "tool")
    return F.when(~known, F.raise_error(F.concat(F.lit("unknown role "), role)).cast("int")).otherwise((role == "assistant").cast("int"))


def check_system_first(turn: Column, role: Column) -> Column:
    """Whether a system message stands anywhere but first."""
    return (role == "system") & (turn > 0)


def tool_groups(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``block``: consecutive messages of one role in a conversation share a number."""
    w = Window.partitionBy(conversation).orderBy(turn)
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))
    return turns.withColumn("_n", new).withColumn("block", F.sum("_n").over(w)).drop("_n")


def preference_pairs(rows: DataFrame, prompt: str, response: str, good: Column, order: str) -> DataFrame:
    """(prompt, chosen, rejected): the first good and the first bad response of each prompt that has both."""
    each = rows.groupBy(prompt).agg(F.min(F.when(good, F.struct(order, response))).alias("g"), F.min(F.when(~good, F.struct(order, response))).alias("b"))
    return each.where("g is not null and b is not null").select(prompt, F.col(f"g.{response}").alias("chosen"), F.col(f"b.{response}").alias("rejected"))


def hash_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``split``: test for about ``share`` of the keys, else train."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u < share, "test").otherwise("train"))


def flat_columns(schema: StructType, sep: str = "/", base: str = "") -> list[Column]:
    """All leaves of nested structs as columns named ``a/b/c``."""
    out: list[Column] = []
    for f in schema.fields:
        path = f"{base}.`{f.name}`" if base else f"`{f.name}`"
        if isinstance(f.dataType, StructType):
            out += [c for c in flat_columns(f.dataType, sep, path)]
        else:
            out.append(F.col(path).alias(path.replace("`", "").replace(".", sep)))
    return out


def write_steps(rows: DataFrame, path: str, step: str = "step", mode: str = "append") -> None:
    """JSON lines, one folder a step."""
    rows.write.mode(mode).partitionBy(step).json(path)


def save_batch(rows: DataFrame, path: str, meta: dict[str, str]) -> None:
    """A batch and its metadata, side by side."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame(list(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/rows"), {r.key: r.value for r in spark.read.schema("key string, value string").json(f"{path}/meta").collect()}


def files_of(spark: SparkSession, folder: str, glob: str = "*.{csv,json,md}") -> DataFrame:
    """(path, length) of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def generate(rows: DataFrame, key: str, prompt: str, n: int, model) -> DataFrame:
    """``responses``: ``n`` for each prompt, by a batched function of a list of prompts and a sample number."""
    import pandas as pd

    def run(parts):
        for g in parts:
            texts = g[prompt].tolist()
            by_sample = [model(texts, i) for i in range(n)]
            yield pd.DataFrame({key: g[key], "responses": [list(x) for x in zip(*by_sample, strict=True)]})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, responses array<string>")


def same_files(spark: SparkSession, source: str, copy: str) -> DataFrame:
    """(name, length, copied) of files whose length differs or that one of two folders lacks; none if the copy is whole."""

    def of(folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
        root = F.regexp_replace(F.lit(folder), "^file:/*", "/")
        path = F.regexp_replace("path", "^file:/*", "/")
        return files.select(F.substring(path, F.length(F.regexp_replace(root, "/+$", "")) + 2, F.length(path)).alias("name"), "length")

    both = of(source).join(of(copy).withColumnRenamed("length", "copied"), "name", "full")
    return both.where(~F.col("length").eqNullSafe(F.col("copied")))


def counting_prompts(rows: DataFrame, seed: int, least: int = 3, most: int = 5) -> DataFrame:
    """(index, prompt, truth) for each row's ``index``: synthetic questions how often a letter is in a word of letters joined by dashes; all by a seeded hash."""
    digit = lambda k, lo, hi: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "index", k)), 1, 8), 16, 10).cast("long") % (hi - lo + 1) + lo).cast("int")
    rows = rows.select("index").withColumn("_n", digit(F.lit("n"), F.lit(least), F.lit(most))).withColumn("_c", digit(F.lit("c"), F.lit(0), F.lit(25)))
    rows = rows.withColumn("truth", digit(F.lit("t"), F.lit(1), F.col("_n")))
    other = lambda i: (F.col("_c") + digit(F.concat(F.lit("o"), i.cast("string")), F.lit(1), F.lit(25))) % 26
    letter = lambda i: F.char(97 + F.when(i <= F.col("truth"), F.col("_c")).otherwise(other(i)))
    letters = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "index", F.lit("s"), i.cast("string"))).alias("h"), letter(i).alias("l")))
    word = F.array_join(F.array_sort(letters).getField("l"), "-")
    return rows.select("index", F.concat(F.lit("How many "), F.char(97 + F.col("_c")), F.lit(" are there in word "), word, F.lit("?")).alias("prompt"), "truth")


def append_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """(key, value) rows of a step in the metric table at ``path``; a step that is written again replaces its rows."""
    metrics.select("key", "value").write.mode("overwrite").parquet(f"{path}/step={step}")


def append_step(rows: DataFrame, path: str, step: int, kind: str = "parquet") -> None:
    """Rows of a step in the table at ``path``, as ``parquet`` or as lines of ``json``; a step that is written again replaces its rows and no other's."""
    rows.write.mode("overwrite").format(kind).save(f"{path}/step={step}")


def contest_rows(rows: DataFrame, date: str, first: str, before: str, public: str, private: str, prompt: str, starter: str) -> DataFrame:
    """Rows whose date text lies in [first, before): ``inputs`` and ``outputs`` of both JSON test lists, public ones first, and whether code is given."""
    tests = "array<struct<input:string,output:string>>"
    cases = F.concat(*[F.coalesce(F.from_json(c, tests), F.array().cast(tests)) for c in (public, private)])
    kept = rows.where((F.col(date) >= first) & (F.col(date) < before)).withColumn("_t", cases)
    return kept.withColumns({"inputs": F.col("_t.input"), "outputs": F.col("_t.output"), "given": F.coalesce(F.length(starter) > 0, F.lit(False)), "prompt": F.trim(prompt)}).drop("_t")


def checked_split(rows: DataFrame, key: str, truth: str, share: float, seed: int) -> DataFrame:
    """``split`` of the rows that have a truth: null and blank ones are left out."""
    return hash_split(rows.where(F.length(F.trim(truth)) > 0), key, share, seed)
