"""Documents to packed training sequences: quality rules, near-dedup, substring dedup, secret scans, packing.

Every stage takes all that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import odd_sketches, packing, quality_rules, repeats, secret_scan, substring_dedup
from rillflow.llm.queries import tokenizer_path
from rillflow.operators.tables import cut, shared_dir


def _rows(docs: DataFrame) -> DataFrame:
    """(row, _id, _th): rows whole, as one column that nothing can clash with, and what tells apart the texts of rows that share a doc_id or have none."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *repeats.keys())


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null texts fail them; repeated rows each pass or fail; an empty table gives none."""
    numbered = [f"c{i}" for i in range(len(docs.columns))]
    judged = quality_rules.quality(docs.toDF(*numbered), text=numbered[docs.columns.index("text")])
    return judged.where("kept").select(*[F.col(n).alias(c) for n, c in zip(numbered, docs.columns, strict=True)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id, then of least text hash; of rows with one doc_id and text one.

    Only rows that a filter of the documents with copies lets pass are shuffled."""
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.NULL_ID)).alias("_id")
    marked = odd_sketches.near_duplicates(docs.select("doc_id", "text"), hashed=True).select(named, F.col("text_hash").alias("_th"), "first")
    judged = marked.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("n"), F.bool_and("first").alias("first")).where("n > 1 or not first")
    judged = cut(judged.select("_id", "_th", "first"), "judged")
    some, others = repeats.Bloom(judged).split(_rows(docs))
    kept = some.join(judged, ["_id", "_th"], "left").where("first is null or first").dropDuplicates(["_id", "_th"])
    return others.select("row").unionAll(kept.select("row")).select(*_columns(docs))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that start earlier in the corpus; those with no word left go. Ids may be null or shared."""
    out = substring_dedup.remove_repeated_words(docs).where("n_words > n_removed")
    return out.select(*_columns(docs, text=F.col("kept"), n_chars=F.length("kept").cast("long")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark. Ids may be null or shared; null texts stay null. Only rows that a filter of the documents with secrets lets pass are shuffled."""
    key = F.struct("_id", "_th").alias("doc_id")
    scanned = secret_scan.secret_scan(_rows(docs).select(key, F.col("row.text").alias("text"), F.col("row.source").alias("source"), F.col("row.doc_id").alias("repository")), repository="repository")
    found = cut(scanned.where("size(spans) > 0"), "spans")
    some, others = repeats.Bloom(found.select("doc_id.*").distinct()).split(_rows(docs))
    changed = secret_scan.redact(some.select("row", key, F.col("row.text").alias("text")), found)
    return others.select("row", F.col("row.text").alias("text")).unionAll(changed.select("row", "text")).select(*_columns(docs, text=F.col("text"), n_chars=F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring), ("secret scans", secrets), ("packing", pack)]

#: SQL can express neither near-dedup by similarity at this size nor tokenizing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/rillflow/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{i}")
    return docs
