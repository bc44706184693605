"""The driver's tables as the engine's concepts, in Spark and as DuckDB CTEs with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.plans.catalog import table

ORDER = ("reward", "length", "num", "part", "supp", "tax", "disc", "ship")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a rollout a row, grouped by order."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as uid", "l_quantity as reward", "cast(floor(l_extendedprice) as bigint) as length", "l_linestatus as data_source", "l_returnflag as flag",
        "l_linenumber as num", "l_partkey as part", "l_suppkey as supp", "l_tax as tax", "l_discount as disc", "l_shipdate as ship",
    )


R = """r AS (SELECT l_orderkey AS uid, l_quantity AS reward, CAST(floor(l_extendedprice) AS BIGINT) AS length, l_linestatus AS data_source, l_returnflag AS flag,
  l_linenumber AS num, l_partkey AS part, l_suppkey AS supp, l_tax AS tax, l_discount AS disc, l_shipdate AS ship FROM lineitem)"""
ROW_ORDER = "reward, length, num, part, supp, tax, disc, ship"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a token a row; a sequence is a user, in order of time. Log-probabilities and the like are made from the event's id."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as seq", "event_id as id", "ts", "value as r", "cast(event_type <> 'error' as int) as m", "event_type as kind",
        "-(event_id % 97) / 50.0D as old", "-(event_id % 97) / 50.0D + ((event_id * 7) % 41 - 20) / 100.0D as new", "-(event_id % 97) / 50.0D + ((event_id * 3) % 11 - 5) / 100.0D as ref",
        "((event_id % 13) - 6) / 3.0D as adv", "(event_id % 29) / 10.0D as v", "(event_id % 31) / 10.0D as ret", "cast(event_id % 50 as bigint) as token",
    )


T = """t AS (SELECT user_id AS seq, event_id AS id, ts, value AS r, (event_type <> 'error')::INT AS m, event_type AS kind,
  -(event_id % 97) / 50.0::DOUBLE AS old, -(event_id % 97) / 50.0::DOUBLE + ((event_id * 7) % 41 - 20) / 100.0::DOUBLE AS new, -(event_id % 97) / 50.0::DOUBLE + ((event_id * 3) % 11 - 5) / 100.0::DOUBLE AS ref,
  ((event_id % 13) - 6) / 3.0::DOUBLE AS adv, (event_id % 29) / 10.0::DOUBLE AS v, (event_id % 31) / 10.0::DOUBLE AS ret, event_id % 50 AS token,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def sequences(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A row a sequence, with arrays of its tokens' columns."""
    packed = tokens(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ts", "id", *columns))).alias("_s"))
    return packed.select("seq", *[F.col(f"_s.{c}").alias(c) for c in columns])


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    """(seq, pos, name) of an array column."""
    return df.select("seq", F.posexplode(array).alias("pos", name)).select("seq", F.col("pos").cast("long").alias("pos"), name)
