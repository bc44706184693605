"""Queries: reward managers and what preference and process rewards need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import grading as g
from rillflow.functions import tokens as tk
from rillflow.operators import rewards
from rillflow.plans.bindings import T, exploded, sequences
from rillflow.plans.catalog import query, table


def _exact(response: Column, truth: Column) -> Column:
    return F.when(response == truth, 1.0).otherwise(0.0)


@query("grade_quantity", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, doc_id % 2 = 0 AS acc, CASE WHEN doc_id % 2 = 0 THEN '\frac{' || n_chars % 9 + 1 || '}{7}' ELSE '[INVALID]' END AS pred FROM documents""")
def grade_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = (F.col("n_chars") % 9 + 1).cast("string")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so\nAnswer: x = $\\frac"), digit, F.lit("7$ dollars"))).otherwise("none")
    s = g.quantity_score(text, F.concat(F.lit("\\frac{"), digit, F.lit("}{7}")))
    return table(spark, sf_dir, "documents").select("doc_id", s.score.alias("score"), s.acc.alias("acc"), s.pred.alias("pred"))


@query("reward_naive", f"""WITH {T}, n AS (SELECT seq, sum(m) AS n FROM t GROUP BY 1) SELECT seq, pos, CASE WHEN pos = n - 1 AND seq % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM t JOIN n USING (seq)""")
def reward_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "m").selectExpr("seq", "m as mask", "cast(seq % 2 as string) as response", "'0' as truth")
    return exploded(rewards.naive(rows, _exact), "rewards", "reward")


@query("reward_batch_and_guarded", "SELECT doc_id, (n_chars % 2)::DOUBLE AS batched, CASE WHEN n_chars % 3 = 0 THEN 0.0 ELSE 2.0 END::DOUBLE AS guarded FROM documents")
def reward_batch_and_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(n_chars as string) as response", "'' as truth")
    a = rewards.batch(rows, lambda r, _: [int(x) % 2 for x in r]).select("doc_id", F.col("reward").alias("batched"))
    b = rewards.prime(rows, lambda r, _: 2.0 if int(r) % 3 else 1 / 0).select("doc_id", F.col("reward").alias("guarded"))
    return a.join(b, "doc_id")


@query("reward_overlong", "SELECT doc_id, round(1 + least(-(n_chars - 3000) / 1000.0::DOUBLE * 0.5::DOUBLE, 0), 6) AS reward FROM documents")
def reward_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang as response", "lang as truth", "n_chars as length")
    return rewards.dapo(rows, _exact, 4000, 1000, 0.5).select("doc_id", F.round("reward", 6).alias("reward"))


@query("reward_offline_eval", "SELECT source, round(avg(((lang = 'en')::INT + (lang = 'fr')::INT + 0) / 3.0::DOUBLE), 6) AS score FROM documents GROUP BY 1")
def reward_offline_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.array(F.lit("en"), F.lit("fr"), F.lit("none")).alias("responses"), F.col("lang").alias("truth"))
    return rewards.offline_scores(rows, "source", "responses", "truth", _exact).withColumn("score", F.round("score", 6))


@query("reward_token_rloo", f"""WITH {T}, q AS (SELECT seq, sum(v * m) / sum(m) AS mean FROM t GROUP BY 1), b AS (SELECT seq, sum(mean) OVER (PARTITION BY seq // 4) / 3 AS base FROM q)
  SELECT seq, pos, round(m * (v * 4 / 3 - base), 6) AS advantage FROM t JOIN b USING (seq)""")  # fmt: skip
def reward_token_rloo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "v", "m").withColumn("g", F.expr("seq div 4"))
    return exploded(rewards.token_rloo(rows, "g", "v", "m", 4), "advantages", "advantage").withColumn("advantage", F.round("advantage", 6))


@query("reward_implicit", f"WITH {T} SELECT seq, round(sum(0.05::DOUBLE * (new - ref)), 6) AS total, round(sum(new) FILTER (token % 5 <> 0), 6) AS logps FROM t GROUP BY 1")
def reward_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "new", "ref", "token")
    labels = F.transform("token", lambda x: F.when(x % 5 == 0, -100).otherwise(x))
    return rows.select("seq", F.round(tk.total(rewards.implicit_rewards(F.col("new"), F.col("ref"), 0.05)), 6).alias("total"), F.round(rewards.label_log_probs(F.col("new"), labels), 6).alias("logps"))


@query("reward_cross_entropy", f"""WITH {T}, z AS (SELECT seq, 0.1::DOUBLE * sum(adv) FILTER (m = 1) AS z FROM t GROUP BY 1)
  SELECT seq, round(greatest(z, 0) - z * (seq % 2) + ln(1 + exp(-abs(z))), 6) AS loss FROM z""")  # fmt: skip
def reward_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, "adv", "m").select("seq", F.round(rewards.cross_entropy(F.col("adv"), (F.col("seq") % 2).cast("double"), F.col("m"), 0.1), 6).alias("loss"))


@query("reward_teacher_gate", f"""WITH {T}, s AS (SELECT seq, count(*) AS n FROM t GROUP BY 1)
  SELECT seq, (n - 5) AS match, CASE WHEN n - 5 < 40 THEN 'short_match' WHEN seq % 7 < 1 THEN 'short_suffix' WHEN n - 5 + seq % 7 > 90 THEN 'too_long' WHEN 90 - (n - 5 + seq % 7) < 10 THEN 'no_room' WHEN seq % 3 = 0 THEN 'low_reward' END AS skip_reason FROM s""")  # fmt: skip
def reward_teacher_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "token").withColumn("teacher", F.concat(F.slice("token", F.lit(1), F.size("token") - 5), F.array(F.lit(-1).cast("long"))))
    suffix = F.slice(F.col("teacher"), F.lit(1), (F.col("seq") % 7).cast("int"))
    gate = rewards.teacher_gate(F.col("token"), F.col("teacher"), suffix, (F.col("seq") % 3).cast("double"), 40, 0.5, 1, 90, 10)
    return rows.select("seq", gate.match.alias("match"), gate.skip_reason.alias("skip_reason"))
