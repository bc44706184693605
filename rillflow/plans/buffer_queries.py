"""Queries: bounded pools and request ledgers, at once and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.tables import shared_dir
from rillflow.plans.catalog import query, table
from rillflow.streaming import buffers

MOST, AGE = 40, 30
_ENTRIES = """e AS (SELECT event_type AS pool, event_id // 10 AS step, event_id AS seq, value, event_id % 4096 AS length FROM events WHERE 4096 - event_id % 4096 >= 409),
  w AS (SELECT *, max(step) OVER (PARTITION BY pool) AS newest FROM e),
  p AS (SELECT pool, step, seq, value FROM w WHERE newest - step <= 30 QUALIFY row_number() OVER (PARTITION BY pool ORDER BY step DESC, seq DESC) <= 40)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type as pool", "event_id div 10 as step", "event_id as seq", "value", "event_id % 4096 as length")
    return buffers.with_room(rows, "length", 4096, 0.1).drop("length")


@query("pool_bounded", f"WITH {_ENTRIES} SELECT pool, step, seq, value FROM p")
def pool_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.pool_batch(_entries(spark, sf_dir), MOST, AGE).select("pool", "step", "seq", "value")


@query("pool_stream", f"WITH {_ENTRIES} SELECT pool, step, seq, value FROM p")
def pool_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over the table in four files, none in order of time."""
    base = f"{shared_dir(spark).rstrip('/')}/rillflow/{spark.sparkContext.applicationId}/pool-{uuid.uuid4().hex}"
    rows = _entries(spark, sf_dir)
    rows.repartition(4, "seq").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    def each(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")

    with buffers.rocks_state(spark):
        changes = buffers.pool_changes(stream, MOST, AGE)
        changes.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return buffers.pool_of(spark.read.parquet(f"{base}/out").drop("n"), "batch", MOST, AGE).select("pool", "step", "seq", "value")


@query("pool_take", """WITH l AS (SELECT user_id, event_id, md5('4:' || event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY md5('4:' || event_id), event_id) AS lap FROM events),
  t AS (SELECT event_id FROM l ORDER BY lap, u, event_id LIMIT 500) SELECT user_id, event_id, event_id IN (SELECT event_id FROM t) AS taken FROM events""")  # fmt: skip
def pool_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample that leaves its pool: who is taken, and who stays."""
    return buffers.taken(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", 500, 4, "event_id").select("user_id", "event_id", "taken")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request an event, a second apart; four of five are answered within 90 seconds, one of three of these by a failure."""
    e = table(spark, sf_dir, "events").selectExpr("user_id % 7 as worker", "event_id * 1000 as at", "cast(event_id as string) as id", "event_id")
    asked = e.select(F.col("worker").cast("string").alias("worker"), "at", "id", F.lit("request").alias("kind"))
    told = e.where("event_id % 5 <> 0").select(F.col("worker").cast("string").alias("worker"), (F.col("at") + (F.col("event_id") * 37) % 90 * 1000 + 1).alias("at"), "id", F.expr("if(event_id % 3 = 0, 'failure', 'answer')").alias("kind"))
    return asked.unionAll(told)


@query("ledger_unbounded", """WITH e AS (SELECT (user_id % 7)::VARCHAR AS worker, event_id * 1000 AS asked, event_id::VARCHAR AS id, (event_id * 37) % 90 * 1000 + 1 AS d, event_id % 5 <> 0 AS told, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'answered' END AS what FROM events)
  SELECT worker, id, 'sent' AS what, asked AS at, 0::BIGINT AS took FROM e UNION ALL SELECT worker, id, what, asked + d, d FROM e WHERE told AND d < 60000
  UNION ALL SELECT worker, id, 'expired', asked + 60000, 60000 FROM e WHERE NOT told OR d >= 60000 UNION ALL SELECT worker, id, 'stale', asked + d, 0 FROM e WHERE told AND d >= 60000""")  # fmt: skip
def ledger_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.ledger_batch(_requests(spark, sf_dir), 1 << 30, 60_000, 1 << 60)


@query("ledger_requests")
def ledger_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests of a worker in flight at once. Tests hold it against a clock, and a stream against it."""
    return buffers.ledger_batch(_requests(spark, sf_dir), 2, 60_000, 1 << 60)
