"""Queries: metrics, evaluation and group filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import metrics
from rillflow.plans.bindings import sequences, R, T, rollouts, tokens
from rillflow.plans.catalog import query, table

_M = [("reward", "reward"), ("prompt_length", "prompt_len"), ("response_length", "response_len"), ("num_turns", "turns")]
_DM = "d AS (SELECT l_quantity AS reward, l_linenumber AS turns, CAST(floor(l_extendedprice) AS BIGINT) AS response_len, l_partkey AS prompt_len FROM lineitem)"


@query("data_metrics", f"WITH {_DM} " + " UNION ALL ".join(f"SELECT 'val/{n}/{k}' AS key, round({f}({c})::DOUBLE, 4) AS value FROM d" for n, c in _M for k, f in (("mean", "avg"), ("max", "max"), ("min", "min")))
       + " UNION ALL SELECT 'val/total_length/clip_ratio', round(avg((prompt_len + response_len >= 50000)::INT), 4) FROM d")
def data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity as reward", "l_linenumber as turns", "cast(floor(l_extendedprice) as bigint) as response_len", "l_partkey as prompt_len")
    return metrics.data_metrics(rows, 50_000, "val/").withColumn("value", F.round("value", 4))


@query("explained_variance", f"WITH {T} SELECT round(1 - var_samp(ret - v) / (var_samp(ret) + 1e-5), 6) AS explained_variance FROM t")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.explained_variance(tokens(spark, sf_dir), "ret", "v").select(F.round("explained_variance", 6).alias("explained_variance"))


@query("value_spread", f"WITH {T} SELECT round(avg(r), 6) AS mean, max(r) AS max, min(r) AS min, round(stddev_samp(r), 6) AS std FROM t")
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.spread(tokens(spark, sf_dir), "r")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("reduce_metric_maps", """SELECT 'value/' || event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT 'k', round(avg(event_id % 7), 6) FROM events""")
def reduce_metric_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.create_map(F.concat(F.lit("value/"), "event_type"), F.col("value"), F.lit("k"), (F.col("event_id") % 7).cast("double")).alias("m"))
    return metrics.reduce_maps(rows, "m").withColumn("value", F.round("value", 6))


@query("timing_metrics", """WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'gen' ELSE event_type END AS key, sum(value) AS value FROM events GROUP BY 1)
  SELECT 'timing_s/' || key AS key, round(value, 4) AS seconds, round(value * 1000 / CASE key WHEN 'gen' THEN 2000 ELSE 10000 END, 4) AS per_token FROM s""")  # fmt: skip
def timing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.when(F.col("event_type") == "click", "gen").otherwise(F.col("event_type")).alias("key")).agg(F.sum("value").alias("value"))
    per = metrics.timing_per_token(rows, 2000, 10_000).withColumnRenamed("value", "per_token")
    named = rows.select("key", F.col("value").alias("seconds"), F.map_keys(metrics.timing_keys(F.create_map("key", "value")))[0].alias("name"))
    return named.join(per, "key").select(F.col("name").alias("key"), F.round("seconds", 4).alias("seconds"), F.round("per_token", 4).alias("per_token"))


@query("throughput", "SELECT l_linenumber::BIGINT AS step, sum(l_partkey)::BIGINT AS total_num_tokens, round(sum(l_quantity), 4) AS time_per_step, round(sum(l_partkey) / (sum(l_quantity) * 8), 6) AS throughput FROM lineitem GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.throughput(F.sum("l_partkey"), F.sum("l_quantity"), 8)
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("step")).agg(t.alias("t")).select("step", "t.*")
    return out.withColumns({"time_per_step": F.round("time_per_step", 4), "throughput": F.round("throughput", 6)})


@query("slowest_row", "SELECT min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 1) AS event_id FROM events")
def slowest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slowest(table(spark, sf_dir, "events"), "value", "event_id").withColumn("mean", F.round("mean", 6))


_KS = "k AS (SELECT n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64], lambda x: x < n), n)) AS k FROM (SELECT DISTINCT n FROM g WHERE n > 1))"


@query("validation_metrics", f"""WITH {R}, g AS (SELECT data_source, uid, list_sort(list(reward)) AS xs, avg(reward) AS mean, stddev_pop(reward) AS std, count(*) AS n FROM r GROUP BY 1, 2), {_KS},
  e AS (SELECT data_source, xs, g.n, k, unnest(range(1, g.n + 1)) AS i, uid FROM g JOIN k USING (n)),
  b AS (SELECT data_source, uid, k, sum(xs[i] * (power(i / n::DOUBLE, k) - power((i - 1) / n::DOUBLE, k))) AS best, sum(xs[i] * (power((n - i + 1) / n::DOUBLE, k) - power((n - i) / n::DOUBLE, k))) AS worst FROM e GROUP BY 1, 2, 3),
  m AS (SELECT data_source, 'mean@' || n AS metric, mean AS value FROM g UNION ALL SELECT data_source, 'std@' || n, std FROM g UNION ALL SELECT data_source, 'best@' || k, best FROM b UNION ALL SELECT data_source, 'worst@' || k, worst FROM b)
  SELECT data_source, metric, round(avg(value), 5) AS value FROM m GROUP BY 1, 2""")  # fmt: skip
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.validation_metrics(rollouts(spark, sf_dir), "data_source", "uid", "reward").withColumn("value", F.round("value", 5))


@query("majority_vote", f"""WITH {R}, v AS (SELECT uid, flag, count(*) AS n, min(length) AS seen FROM r GROUP BY 1, 2), f AS (SELECT v.uid, v.flag, v.n, v.seen, min(r.reward) AS value FROM v JOIN r ON r.uid = v.uid AND r.flag = v.flag AND r.length = v.seen GROUP BY ALL)
  SELECT uid, n AS votes, value FROM f QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, seen, value) = 1""")  # fmt: skip
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.majority(rollouts(spark, sf_dir), ["uid"], "flag", "reward", "length").select("uid", "votes", "value")


@query("bootstrap_metric", f"""WITH {R}, p AS (SELECT data_source, flag, reward, row_number() OVER (PARTITION BY data_source, flag ORDER BY reward) - 1 AS i, count(*) OVER (PARTITION BY data_source, flag) AS n FROM r),
  g AS (SELECT data_source, flag, any_value(n) AS n FROM p GROUP BY 1, 2), d AS (SELECT data_source, flag, n, unnest(range(200)) AS draw FROM g), k AS (SELECT *, unnest(range(4)) AS k FROM d),
  t AS (SELECT *, floor(('0x' || substr(md5('42:' || data_source || ':' || flag || ':' || draw || ':' || k), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE * n)::BIGINT AS i FROM k),
  e AS (SELECT data_source, flag, draw, avg(reward) AS m, max(reward) AS hi, min(reward) AS lo FROM t JOIN p USING (data_source, flag, i) GROUP BY 1, 2, 3)
  SELECT data_source, flag, round(avg(m), 6) AS mean_mean, round(stddev_pop(m), 6) AS mean_std, round(avg(hi), 6) AS max_mean, round(stddev_pop(hi), 6) AS max_std, round(avg(lo), 6) AS min_mean, round(stddev_pop(lo), 6) AS min_std FROM e GROUP BY 1, 2""")  # fmt: skip
def bootstrap_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.bootstrap(rollouts(spark, sf_dir), ["data_source", "flag"], "reward", 4, 200, 42)
    return out.select("data_source", "flag", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("data_source", "flag")])


@query("source_rollup", f"WITH {R}, p AS (SELECT data_source, uid, avg(reward) AS m FROM r GROUP BY 1, 2), s AS (SELECT data_source, avg(m) AS score, count(*) AS prompts FROM p GROUP BY 1) SELECT data_source, round(score, 6) AS score, prompts, round((SELECT avg(score) FROM s), 6) AS cross_source FROM s")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = rollouts(spark, sf_dir).groupBy("data_source", "uid").agg(F.avg("reward").alias("m"))
    s = each.groupBy("data_source").agg(F.avg("m").alias("score"), F.count(F.lit(1)).alias("prompts"))
    return s.join(F.broadcast(s.agg(F.avg("score").alias("cross_source")))).select("data_source", F.round("score", 6).alias("score"), "prompts", F.round("cross_source", 6).alias("cross_source"))


@query("dynamic_sampling_filter", f"WITH {R}, k AS (SELECT * FROM r QUALIFY stddev_pop(reward) OVER (PARTITION BY uid) > 0 OR count(*) OVER (PARTITION BY uid) = 1) SELECT uid, reward, length FROM k WHERE uid IN (SELECT DISTINCT uid FROM k ORDER BY uid LIMIT 2000)")
def dynamic_sampling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_groups(metrics.keep_mixed_groups(rollouts(spark, sf_dir), "uid", "reward"), "uid", 2000).select("uid", "reward", "length")


@query("oversample_filter", f"""WITH {R}, e AS (SELECT uid, avg((reward > 25)::INT) AS a, max((length > 80000)::INT) AS c FROM r GROUP BY 1),
  k AS (SELECT uid FROM e ORDER BY CASE WHEN a >= 0.2 AND a <= 0.8 AND c = 0 THEN 0 ELSE 1 END, uid LIMIT (SELECT count(*) // 4 FROM e)) SELECT uid, reward, length FROM r WHERE uid IN (SELECT uid FROM k)""")  # fmt: skip
def oversample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir).withColumn("acc", (F.col("reward") > 25).cast("double")).withColumn("clipped", F.col("length") > 80_000)
    return metrics.filter_and_downsample(rows, "uid", "acc", "clipped", 0.2, 0.8, 4).select("uid", "reward", "length")


_P = "p AS (SELECT d.lang, d.source, d.doc_id, d.n_chars AS score, l.quality AS acc FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("acc")), "doc_id")


@query("pair_accuracy", f"WITH {_P}, x AS (SELECT a.lang, sum((a.score > b.score)::INT)::DOUBLE / count(*) AS acc FROM p a JOIN p b ON a.lang = b.lang AND a.acc = 1 AND b.acc = 0 GROUP BY 1) SELECT lang, round(coalesce(acc, 0.5), 6) AS accuracy FROM (SELECT DISTINCT lang FROM p) LEFT JOIN x USING (lang)")
def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_accuracy(_labelled(spark, sf_dir), "lang", "doc_id", "score", "acc").withColumn("accuracy", F.round("accuracy", 6))


@query("opposite_mean", f"WITH {_P} SELECT doc_id, round(CASE WHEN acc = 1 THEN avg(score) FILTER (acc = 0) OVER w ELSE avg(score) FILTER (acc = 1) OVER w END, 6) AS opposite FROM p WINDOW w AS (PARTITION BY lang, source)")
def opposite_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("g", F.concat_ws(":", "lang", "source"))
    return metrics.opposite_mean(rows, "g", "score", "acc").select("doc_id", F.round("opposite", 6).alias("opposite"))


@query("pair_winner", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY n_chars DESC, doc_id) = 1 AS wins FROM documents")
def pair_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 2 as pair", "n_chars")
    return metrics.pair_winner(rows, "pair", "doc_id", "n_chars").select("doc_id", "wins")


@query("running_best", "SELECT event_id, coalesce(value > max(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM events")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_best(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value").select("event_id", "improved")


@query("trajectory_islands", """WITH n AS (SELECT user_id, event_id, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM n) SELECT event_id, (row_number() OVER (PARTITION BY user_id, s ORDER BY event_id) - 1)::INT AS place FROM s""")  # fmt: skip
def trajectory_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.islands(table(spark, sf_dir, "events"), "event_id", "event_type", "user_id").select("event_id", F.col("place").cast("int").alias("place"))


@query("sliding_window_stats", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS recent FROM events")
def sliding_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("recent"))


@query("usage_join", f"""WITH {R}, e AS (SELECT o_orderkey AS uid, o_orderpriority AS entry FROM orders) SELECT entry, count(*) FILTER (reward > 25) AS k_succ, count(*) AS k_total FROM r JOIN e USING (uid) GROUP BY 1""")
def usage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("entry"))
    per = rollouts(spark, sf_dir).groupBy("uid").agg(F.count_if(F.col("reward") > 25).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.join(entries, "uid").groupBy("entry").agg(F.sum("s").alias("k_succ"), F.sum("n").alias("k_total"))


@query("paired_group_stats", f"""WITH {R}, g AS (SELECT uid, count(*) FILTER (reward > 25) AS s, count(*) AS n FROM r GROUP BY 1), p AS (SELECT a.uid, a.s AS root_s, a.n AS root_n, b.s AS pre_s, b.n AS pre_n FROM g a JOIN g b ON b.uid = a.uid + 1)
  SELECT count(*) AS pairs, round(avg(pre_s / pre_n - root_s / root_n), 6) AS gain, count(*) FILTER (root_s = 0) AS root_zero, round(avg(pre_s / pre_n) FILTER (root_s = 0), 6) AS gain_zero, count(*) FILTER (root_s <= 1) AS root_low FROM p""")  # fmt: skip
def paired_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rollouts(spark, sf_dir).groupBy("uid").agg(F.count_if(F.col("reward") > 25).alias("s"), F.count(F.lit(1)).alias("n"))
    b = g.select((F.col("uid") - 1).alias("uid"), F.col("s").alias("ps"), F.col("n").alias("pn"))
    p = g.join(b, "uid")
    rate = F.col("ps") / F.col("pn")
    return p.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(rate - F.col("s") / F.col("n")), 6).alias("gain"), F.count_if(F.col("s") == 0).alias("root_zero"),
        F.round(F.avg(F.when(F.col("s") == 0, rate)), 6).alias("gain_zero"), F.count_if(F.col("s") <= 1).alias("root_low"),
    )


@query("critic_metrics", f"""WITH {T}, s AS (SELECT seq, sum(r) AS score, sum(r * m) AS reward, count(*) AS response_len, count(*) FILTER (m = 0) AS prompt_len FROM t GROUP BY seq), k AS (SELECT * FROM t WHERE m > 0),
  x AS (SELECT unnest(['critic/score', 'critic/rewards', 'response_length', 'prompt_length']) AS n, unnest([score, reward, response_len::DOUBLE, prompt_len::DOUBLE]) AS v FROM s UNION ALL SELECT unnest(['critic/advantages', 'critic/returns', 'critic/values']), unnest([adv, ret, v]) FROM k)
  SELECT n || '/mean' AS key, round(avg(v), 4) AS value FROM x GROUP BY n UNION ALL SELECT n || '/max', round(max(v), 4) FROM x GROUP BY n UNION ALL SELECT n || '/min', round(min(v), 4) FROM x GROUP BY n
  UNION ALL SELECT 'response_length/clip_ratio', round(avg((response_len = 70)::INT), 4) FROM s UNION ALL SELECT 'prompt_length/clip_ratio', round(avg((prompt_len = 10)::INT), 4) FROM s
  UNION ALL SELECT 'critic/vf_explained_var', round(1 - var_samp(ret - v) / (var_samp(ret) + 1e-5), 4) FROM k""")  # fmt: skip
def critic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "r", "m", "adv", "ret", "v")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.select(
        "seq", total(F.col("r")).alias("score"), total(F.zip_with("r", "m", lambda a, b: a * b)).alias("reward"), F.size("r").alias("response_len"), F.size(F.filter("m", lambda x: x == 0)).alias("prompt_len"),
        F.col("adv").alias("advantages"), F.col("ret").alias("returns"), F.col("v").alias("values"), F.col("m").alias("mask"),
    )
    return metrics.critic_metrics(rows, 70, 10).withColumn("value", F.round("value", 4))
