"""Queries: advantages, losses and token recurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions import tokens as tk
from rillflow.operators import advantages, batches, losses
from rillflow.plans.bindings import R, T, exploded, rollouts, sequences, tokens
from rillflow.plans.catalog import query, table


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


W1 = "WINDOW w AS (PARTITION BY uid)"


@query(
    "grpo_advantage",
    """SELECT l_orderkey AS uid, l_quantity AS reward,
       round(CASE WHEN count(*) OVER w = 1 THEN l_quantity / (1 + 1e-6::DOUBLE)
             ELSE (l_quantity - avg(l_quantity) OVER w) / (stddev_samp(l_quantity) OVER w + 1e-6::DOUBLE) END, 6) AS advantage
       FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(advantages.grpo(rollouts(spark, sf_dir).select("uid", "reward")), "advantage")


def _estimator(name: str, sql: str, estimator: str | None = None, **parameters: object) -> None:
    @query(f"advantage_{name}", f"WITH {R} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = advantages.compute_advantage(estimator or name, rollouts(spark, sf_dir), **parameters)
        return _r6(out.select("uid", "reward", "length", "advantage"), "advantage")


_estimator("grpo_centred", f"SELECT uid, reward, length, round(reward - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(reward) OVER w END, 6) AS advantage FROM r {W1}", "grpo", by_std=False)
_estimator("rloo", f"SELECT uid, reward, length, round(CASE WHEN count(*) OVER w = 1 THEN reward ELSE (reward - avg(reward) OVER w) * count(*) OVER w / greatest(count(*) OVER w - 1, 1) END, 6) AS advantage FROM r {W1}")
_estimator("opo", f"SELECT uid, reward, length, round(reward - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE sum(length::DOUBLE * reward) OVER w / sum(length::DOUBLE) OVER w END, 6) AS advantage FROM r {W1}")
_estimator("gpg", f"SELECT uid, reward, length, round((SELECT count(*)::DOUBLE / greatest(count(*) FILTER (reward <> 0), 1) FROM r) * (reward - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(reward) OVER w END) / 1.0, 6) AS advantage FROM r {W1}")
_estimator("sibling_mean", f"SELECT uid, reward, length, round(reward - avg(reward) OVER w, 6) AS advantage FROM r {W1}")
_estimator(
    "reinforce_plus_plus_baseline",
    f""", c AS (SELECT uid, reward, length, reward - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(reward) OVER w END AS c FROM r {W1}),
    s AS (SELECT sum(length::DOUBLE) AS n, sum(length * c) AS s, sum(length * c) / (sum(length::DOUBLE) + 1e-8) AS mean FROM c),
    v AS (SELECT sum(length * (c - mean) * (c - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM c, s)
    SELECT uid, reward, length, round((c - mean) / sqrt(var + 1e-8), 6) AS advantage FROM c, s, v""",
)


@query("advantage_grpo_passk", f"""WITH {R}, g AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM r), k AS (SELECT * FROM g WHERE n > 1),
  o AS (SELECT uid, reward, length, row_number() OVER x AS rn, lead(reward) OVER x AS nxt, stddev_samp(reward) OVER (PARTITION BY uid) AS sd FROM k WINDOW x AS (PARTITION BY uid ORDER BY reward DESC, length, num, part, supp, tax, disc, ship))
  SELECT uid, reward, length, round(CASE WHEN rn = 1 THEN (reward - nxt) / (sd + 1e-6::DOUBLE) ELSE 0 END, 6) AS advantage FROM o""")  # fmt: skip
def advantage_grpo_passk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir)
    pairs = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uid"))).where("n > 1")
    out = advantages.compute_advantage("grpo_passk", pairs, order=("length", "num", "part", "supp", "tax", "disc", "ship"))
    return _r6(out.select("uid", "reward", "length", "advantage"), "advantage")


@query("advantage_snis", f"""WITH {R}, g AS (SELECT uid, reward, reward - avg(reward) OVER w AS a, flag = 'R' AS teacher FROM r {W1}),
  e AS (SELECT *, exp((a - max(a) OVER w) / 2.0) AS e FROM g {W1})
  SELECT uid, reward, round(CASE WHEN teacher THEN e / avg(e) OVER w END, 6) AS weight FROM e {W1}""")  # fmt: skip
def advantage_snis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = advantages.sibling_mean(rollouts(spark, sf_dir)).withColumn("teacher", F.col("flag") == "R")
    return _r6(advantages.snis_weights(rows, beta=2.0).select("uid", "reward", "weight"), "weight")


@query("advantage_broadcast_nonzero", """WITH a AS (SELECT user_id AS seq, round(avg(value), 6) AS x, sum((event_type <> 'error')::INT) AS n FROM events GROUP BY user_id)
  SELECT seq, n::DOUBLE AS n, round(n * x, 1) AS total FROM a WHERE abs(n * x) > 1e-8""")  # fmt: skip
def advantage_broadcast_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "r", "m").withColumn("x", F.round(tk.total("r") / F.size("r"), 6))
    rows = advantages.keep_nonzero(rows.withColumn("advantages", advantages.broadcast_over(F.col("x"), F.col("m"))))
    return rows.select("seq", tk.total("m").alias("n"), F.round(tk.total("advantages"), 1).alias("total"))


@query("mixed_reward_group_stats", f"""WITH {R} SELECT uid, count(*) AS k_total, count(*) FILTER (reward > 25) AS k_succ, count(*) FILTER (reward <= 25) AS k_fail,
  round(count(*) FILTER (reward > 25) / count(*)::DOUBLE, 6) AS rate FROM r GROUP BY uid""")  # fmt: skip
def mixed_reward_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("reward") > 25
    return rollouts(spark, sf_dir).groupBy("uid").agg(
        F.count(F.lit(1)).alias("k_total"), F.count_if(ok).alias("k_succ"), F.count_if(~ok).alias("k_fail"), F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("rate")
    )


# Token expressions.


@query("token_rewards", f"WITH {T} SELECT id, round(r - 0.05::DOUBLE * (old - ref), 6) AS reward FROM t")
def token_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("id", F.round(losses.token_rewards(F.col("r"), F.col("old"), F.col("ref"), 0.05), 6).alias("reward"))


@query("kl_penalties", f"""WITH {T}, d AS (SELECT id, old - ref AS d FROM t)
  SELECT id, round(d, 6) AS k1, round(abs(d), 6) AS kabs, round(0.5 * d * d, 6) AS k2, round(greatest(least(exp(greatest(least(-d, 20), -20)) - greatest(least(-d, 20), -20) - 1, 10), -10), 6) AS k3 FROM d""")  # fmt: skip
def kl_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"k1": "kl", "kabs": "abs", "k2": "mse", "k3": "low_var_kl"}
    return tokens(spark, sf_dir).select("id", *[F.round(losses.kl_penalty(F.col("old"), F.col("ref"), k), 6).alias(n) for n, k in kinds.items()])


@query("apply_kl_penalty", f"""WITH {T}, k AS (SELECT seq, id, m, r - 0.1::DOUBLE * (old - ref) * m AS reward, (old - ref) * m AS kl FROM t),
  s AS (SELECT seq, sum(kl) / (sum(m) + 1e-8) AS kl, sum(reward) AS reward FROM k GROUP BY seq) SELECT seq, round(kl, 6) AS kl, round(reward, 4) AS reward FROM s""")  # fmt: skip
def apply_kl_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = losses.kl_penalty(F.col("old"), F.col("ref"), "kl") * F.col("m")
    return tokens(spark, sf_dir).groupBy("seq").agg(F.round(F.sum(k) / (F.sum("m") + 1e-8), 6).alias("kl"), F.round(F.sum(F.col("r") - 0.1 * k), 4).alias("reward"))


@query("ppo_policy_loss", f"""WITH {T}, a AS (SELECT id, adv, greatest(least(new - old, 20), -20) AS s FROM t), b AS (SELECT id, adv, s, exp(s) AS ratio FROM a),
  c AS (SELECT id, adv, s, -adv * ratio AS l1, -adv * greatest(least(ratio, 1.2::DOUBLE), 0.8::DOUBLE) AS l2 FROM b)
  SELECT id, round(CASE WHEN adv < 0 THEN least(-adv * 3, greatest(l1, l2)) ELSE greatest(l1, l2) END, 6) AS loss, (l2 > l1)::DOUBLE AS clipped, round(-s, 6) AS kl, (greatest(l1, l2) > -adv * 3 AND adv < 0)::DOUBLE AS clipped_low FROM c""")  # fmt: skip
def ppo_policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = losses.policy_loss(F.col("old"), F.col("new"), F.col("adv"))
    return _r6(tokens(spark, sf_dir).select("id", *[c.alias(n) for n, c in parts.items()]), "loss", "kl")


@query("shaping_and_gpg_loss", f"WITH {T} SELECT id, round(-adv * exp(new) / (exp(new) + 0.1::DOUBLE), 6) AS shaped, round(-new * adv, 6) AS gpg FROM t")
def shaping_and_gpg_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("id", F.round(losses.shaping_loss(F.col("new"), F.col("adv")), 6).alias("shaped"), F.round(losses.gpg_loss(F.col("new"), F.col("adv")), 6).alias("gpg"))


@query("value_loss", f"""WITH {T}, a AS (SELECT id, (v - ret) * (v - ret) AS l1, power(greatest(least(v, ret + 0.3::DOUBLE + 0.2::DOUBLE), ret + 0.3::DOUBLE - 0.2::DOUBLE) - ret, 2) AS l2 FROM t)
  SELECT id, round(0.5 * greatest(l1, l2), 6) AS loss, (l2 > l1)::DOUBLE AS clipped FROM a""")  # fmt: skip
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = losses.value_loss(F.col("v"), F.col("ret") + 0.3, F.col("ret"), 0.2)
    return _r6(tokens(spark, sf_dir).select("id", *[c.alias(n) for n, c in parts.items()]), "loss")


_MODES = {
    "token-mean": "SELECT sum(m * -adv * new) / (sum(m) + 1e-8) AS loss FROM t",
    "seq-mean-token-sum": "SELECT avg(s) AS loss FROM q",
    "seq-mean-token-mean": "SELECT avg(s / n) AS loss FROM q",
    "seq-mean-token-sum-norm": "SELECT sum(s) / 1024::DOUBLE AS loss FROM q",
}


@query("agg_loss_modes", f"WITH {T}, q AS (SELECT seq, sum(m * -adv * new) AS s, sum(m) AS n FROM t GROUP BY seq) " + " UNION ALL ".join(f"SELECT '{k}' AS mode, round(loss, 6) AS loss FROM ({q})" for k, q in _MODES.items()))
def agg_loss_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).withColumn("loss", losses.gpg_loss(F.col("new"), F.col("adv")))
    parts = [losses.agg_loss(rows, "loss", "m", "seq", k, 1024).select(F.lit(k).alias("mode"), F.round("loss", 6).alias("loss")) for k in _MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_COV = f"""WITH {T}, c AS (SELECT id, m, (adv - avg(adv) FILTER (m = 1) OVER ()) * (new - avg(new) FILTER (m = 1) OVER ()) AS cov FROM t),
  n AS (SELECT greatest(1, floor(count(*) FILTER (m = 1) * 0.02::DOUBLE))::BIGINT AS n FROM t)"""


@query("clip_cov", f"""{_COV}, i AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR)) AS rn FROM c WHERE m = 1 AND cov > 0.2::DOUBLE AND cov < 0.9::DOUBLE)
  SELECT c.id, round(cov, 6) AS cov, CASE WHEN i.rn <= (SELECT n FROM n) THEN 0 ELSE 1 END AS keep FROM c LEFT JOIN i USING (id)""")  # fmt: skip
def clip_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses.clip_cov(tokens(spark, sf_dir), 0.2, 0.9, 0.02, [F.md5(F.col("id").cast("string")).alias("h")], logp="new", advantage="adv", mask="m")
    return _r6(rows.select("id", "cov", "keep"), "cov")


@query("kl_cov", f"""{_COV}, i AS (SELECT id, row_number() OVER (ORDER BY round(cov, 6) DESC, id) AS rn FROM c WHERE m = 1)
  SELECT c.id, round(cov, 6) AS cov, CASE WHEN i.rn <= (SELECT n FROM n) THEN 1 ELSE 0 END AS penalised FROM c LEFT JOIN i USING (id)""")  # fmt: skip
def kl_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(_kl_cov(tokens(spark, sf_dir)).select("id", "cov", "penalised"), "cov")


def _kl_cov(rows: DataFrame) -> DataFrame:
    with_cov = losses._covariance(rows, "new", "adv", "m").withColumn("cov", F.round("cov", 6))
    n = with_cov.agg(F.greatest(F.lit(1), F.floor(F.count_if(F.col("m") == 1) * 0.02)).alias("n")).first()["n"]
    key = F.struct((-F.col("cov")).alias("c"), "id")
    last = batches.number(with_cov.where("m = 1").select(key.alias("k")), "k").where(F.col("row_id") < int(n)).agg(F.max("k").alias("last"))
    return with_cov.join(F.broadcast(last)).withColumn("penalised", ((F.col("m") == 1) & (key <= F.col("last"))).cast("int"))


@query("adaptive_kl", """WITH s AS (SELECT event_id AS step, (event_id % 17) / 100.0::DOUBLE AS kl, 64 AS n FROM events)
  SELECT step, round(0.2::DOUBLE * exp(sum(ln(1 + greatest(least(kl / 0.06::DOUBLE - 1, 0.2::DOUBLE), -0.2::DOUBLE) * n / 10000.0::DOUBLE)) OVER (ORDER BY step)), 6) AS beta FROM s""")  # fmt: skip
def adaptive_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").selectExpr("event_id as step", "(event_id % 17) / 100.0D as kl", "64 as n")
    return _r6(losses.adaptive_kl(steps, 0.2, 0.06, 10000.0).select("step", "beta"), "beta")


@query("dpo_losses", f"""WITH {T}, z AS (SELECT id, (new - old) - (ref - old) AS z FROM t), y AS (SELECT id, z, 0.5::DOUBLE * z AS x FROM z)
  SELECT id, round(0.9::DOUBLE * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + 0.1::DOUBLE * (greatest(x, 0) + ln(1 + exp(-abs(x)))), 6) AS sigmoid, round((z - 1) * (z - 1), 6) AS ipo FROM y""")  # fmt: skip
def dpo_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col("new"), F.col("old"), F.col("ref"), F.col("old")]
    return tokens(spark, sf_dir).select("id", F.round(losses.dpo_loss(*c, beta=0.5, smoothing=0.1), 6).alias("sigmoid"), F.round(losses.dpo_loss(*c, beta=0.5, kind="ipo"), 6).alias("ipo"))


@query("softmean", f"WITH {T}, x AS (SELECT seq, new, max(3 * new) OVER (PARTITION BY seq) AS t FROM t) SELECT seq, round((any_value(t) + ln(sum(exp(3 * new - t))) - ln(count(*))) / 3, 6) AS softmean FROM x GROUP BY seq")
def softmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(losses.softmean(tokens(spark, sf_dir), "seq", "new", 3.0), "softmean")


@query("sppo_loss", f"WITH {T} SELECT seq, round(power(sum((new - old) * m) - 0.5::DOUBLE * max(r), 2), 4) AS loss FROM t GROUP BY seq")
def sppo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.sppo_loss(tokens(spark, sf_dir), "seq", "old", "new", "r", "m", 0.5).select("seq", F.round("loss", 4).alias("loss"))


# Sequences.


@query("masked_statistics", f"""WITH {T}, a AS (SELECT seq, sum(m) AS n, sum(v) FILTER (m = 1) AS s, sum(v) FILTER (m = 1) / (sum(m) + 1e-8) AS mean FROM t GROUP BY seq),
  b AS (SELECT seq, any_value(n) AS n, any_value(s) AS s, any_value(mean) AS mean, sum((v - mean) * (v - mean)) FILTER (m = 1) / (any_value(n) + 1e-8) AS var FROM t JOIN a USING (seq) GROUP BY seq)
  SELECT seq, round(s, 6) AS total, round(mean, 6) AS mean, round(var * n / (n - 1), 6) AS var FROM b WHERE n > 1""")  # fmt: skip
def masked_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "v", "m").where(tk.total("m") > 1)
    return rows.select("seq", F.round(tk.masked_sum("v", "m"), 6).alias("total"), F.round(tk.masked_mean("v", "m"), 6).alias("mean"), F.round(tk.masked_var("v", "m"), 6).alias("var"))


@query("masked_whiten", f"""WITH {T}, a AS (SELECT seq, sum(m) AS n, sum(v) FILTER (m = 1) / (sum(m) + 1e-8) AS mean FROM t GROUP BY seq),
  b AS (SELECT seq, any_value(n) AS n, any_value(mean) AS mean, sum((v - mean) * (v - mean)) FILTER (m = 1) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM t JOIN a USING (seq) WHERE n > 1 GROUP BY seq)
  SELECT seq, pos, round((v - mean) / sqrt(var + 1e-8), 6) AS w FROM t JOIN b USING (seq)""")  # fmt: skip
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "v", "m").where(tk.total("m") > 1)
    return _r6(exploded(rows.withColumn("w", tk.masked_whiten("v", "m")), "w", "w"), "w")


@query("response_mask", f"""WITH {T}, e AS (SELECT seq, min(pos) FILTER (token IN (7, 11)) AS p FROM t GROUP BY seq)
  SELECT seq, pos, CASE WHEN p IS NULL OR pos <= p THEN 1 ELSE 0 END AS mask FROM t JOIN e USING (seq)""")  # fmt: skip
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(sequences(spark, sf_dir, "token").withColumn("mask", tk.response_mask("token", (7, 11))), "mask", "mask")


@query("position_ids", f"WITH {T} SELECT seq, pos, greatest(sum(m) OVER (PARTITION BY seq ORDER BY pos) - 1, 0)::INT AS position FROM t")
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(sequences(spark, sf_dir, "m").withColumn("p", tk.position_ids("m")), "p", "position")


@query("remax_advantage", f"""WITH {T} SELECT seq, pos, round(sum(r * m) OVER (PARTITION BY seq ORDER BY pos DESC) - 0.5::DOUBLE * m, 4) AS advantage FROM t""")
def remax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("seq").orderBy(F.desc("ts"), F.desc("id"))
    at = F.row_number().over(Window.partitionBy("seq").orderBy("ts", "id")).cast("long") - 1
    return tokens(spark, sf_dir).select("seq", at.alias("pos"), F.round(F.sum(F.col("r") * F.col("m")).over(w) - 0.5 * F.col("m"), 4).alias("advantage"))


@query("reinforce_plus_plus_returns", f"""WITH RECURSIVE {T}, l AS (SELECT seq, max(pos) AS last FROM t GROUP BY seq),
  g AS (SELECT t.seq, t.pos, t.r AS g, t.m FROM t JOIN l ON t.seq = l.seq AND t.pos = l.last
    UNION ALL SELECT t.seq, t.pos, t.r + 0.9::DOUBLE * g.g * g.m, t.m FROM g JOIN t ON t.seq = g.seq AND t.pos = g.pos - 1)
  SELECT seq, pos, round(g, 6) AS ret FROM g""")  # fmt: skip
def reinforce_plus_plus_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "r", "m").withColumn("ret", tk.discounted_returns("r", "m", 0.9))
    return exploded(rows, "ret", "ret").withColumn("ret", F.round("ret", 6))


@query("gae_advantage", f"""WITH RECURSIVE {T}, l AS (SELECT seq, max(pos) AS last FROM t GROUP BY seq),
  g AS (SELECT t.seq, t.pos, t.v * t.m AS nv, (t.r - t.v) * t.m AS g, t.v FROM t JOIN l ON t.seq = l.seq AND t.pos = l.last
    UNION ALL SELECT t.seq, t.pos, t.v * t.m + (1 - t.m) * g.nv, (t.r + 0.9::DOUBLE * g.nv - t.v + 0.72::DOUBLE * g.g) * t.m + (1 - t.m) * g.g, t.v FROM g JOIN t ON t.seq = g.seq AND t.pos = g.pos - 1)
  SELECT seq, pos, round(g, 4) AS advantage, round(g + v, 4) AS ret FROM g""")  # fmt: skip
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "r", "v", "m").withColumn("a", tk.gae("r", "v", "m", 0.9, 0.8))
    rows = rows.withColumn("x", F.zip_with("a", "v", lambda a, v: F.struct(F.round(a, 4).alias("advantage"), F.round(a + v, 4).alias("ret"))))
    return exploded(rows, "x", "x").select("seq", "pos", "x.*")


@query("pad_and_fit", f"""WITH {T}, s AS (SELECT seq, list(token ORDER BY pos) AS a, count(*) AS n FROM t GROUP BY seq)
  SELECT seq, n, list_aggregate(CASE WHEN n > 64 THEN a[-64:] ELSE list_concat(list_resize([]::BIGINT[], 64 - n, -1), a) END, 'sum')::BIGINT AS left_sum,
   list_aggregate(CASE WHEN n > 64 THEN a[:64] ELSE list_concat(a, list_resize([]::BIGINT[], 64 - n, -1)) END, 'sum')::BIGINT AS right_sum,
   list_aggregate(CASE WHEN n > 64 THEN list_concat(a[:32], a[-32:]) ELSE list_concat(a, list_resize([]::BIGINT[], 64 - n, -1)) END, 'sum')::BIGINT AS middle_sum FROM s""")  # fmt: skip
def pad_and_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = sequences(spark, sf_dir, "token")
    kinds = {"left_sum": ("left", True), "right_sum": ("right", False), "middle_sum": ("middle", False)}
    return rows.select("seq", F.size("token").cast("long").alias("n"), *[add(tk.fit("token", 64, -1, left, cut)).alias(n) for n, (cut, left) in kinds.items()])


@query("token_digest", f"WITH {T} SELECT seq, sha1(string_agg(token::VARCHAR, ',' ORDER BY pos)) AS digest FROM t GROUP BY seq")
def token_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, "token").select("seq", tk.digest("token").alias("digest"))


@query("common_prefix", f"""WITH {T}, p AS (SELECT a.seq, a.pos, a.token % 3 = b.token % 3 AS same FROM t a JOIN t b ON b.seq = a.seq + 1 AND a.pos = b.pos), n AS (SELECT seq, count(*) AS n FROM t GROUP BY seq)
  SELECT a.seq, coalesce((SELECT min(pos) FROM p WHERE p.seq = a.seq AND NOT same), least(a.n, b.n)) AS prefix FROM n a JOIN n b ON b.seq = a.seq + 1""")  # fmt: skip
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "token").select("seq", F.transform("token", lambda x: x % 3).alias("a"))
    other = rows.select((F.col("seq") - 1).alias("seq"), F.col("a").alias("b"))
    return rows.join(other, "seq").select("seq", tk.common_prefix("a", "b").alias("prefix"))


@query("append_eos_and_prefix", f"""WITH {T}, s AS (SELECT seq, list(token ORDER BY pos) AS a FROM t GROUP BY seq)
  SELECT seq, len(CASE WHEN a[-1] = 7 THEN a ELSE list_append(a, 7) END)::INT AS n, TRUE AS prefix, a[-1] <> 7 AS strict_prefix FROM s""")  # fmt: skip
def append_eos_and_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "token").withColumn("e", tk.append_eos("token", 7))
    return rows.select("seq", F.size("e").alias("n"), tk.is_prefix("token", "e").alias("prefix"), tk.is_prefix("token", "e", strict=True).alias("strict_prefix"))


@query("stop_spans", f"""WITH {T}, k AS (SELECT seq, pos, coalesce(sum((token IN (3, 9))::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM t)
  SELECT seq, min(pos)::INT AS "start", (max(pos) + 1)::INT AS "end" FROM k GROUP BY seq, part""")  # fmt: skip
def stop_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, "token").select("seq", F.explode(tk.spans_at_stops("token", (3, 9))).alias("s")).select("seq", "s.*")


@query("fixed_spans", f"""WITH {T}, n AS (SELECT seq, count(*) AS n FROM t GROUP BY seq),
  a AS (SELECT seq, 'length' AS kind, unnest(range(0, n, 25)) AS s, n, 0 AS k FROM n),
  b AS (SELECT seq, 'count' AS kind, unnest(range(0, greatest(least(4, n), 1))) AS i, n, least(4, n) AS k FROM n)
  SELECT seq, kind, s::INT AS "start", least(s + 25, n)::INT AS "end" FROM a
  UNION ALL SELECT seq, kind, (i * (n // k) + least(i, n % k))::INT, ((i + 1) * (n // k) + least(i + 1, n % k))::INT FROM b""")  # fmt: skip
def fixed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "token")
    a = rows.select("seq", F.lit("length").alias("kind"), F.explode(tk.spans_of("token", 25)).alias("s"))
    b = rows.select("seq", F.lit("count").alias("kind"), F.explode(tk.spans_in("token", 4)).alias("s"))
    return a.unionAll(b).select("seq", "kind", F.col("s.start").cast("int").alias("start"), F.col("s.end").cast("int").alias("end"))


@query("logits_entropy", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, max(x) AS t FROM e GROUP BY vec_id),
  z AS (SELECT vec_id, any_value(t) + ln(sum(exp(x - t))) AS z FROM e JOIN m USING (vec_id) GROUP BY vec_id),
  h AS (SELECT vec_id, any_value(z) - sum(exp(x - z) * x) AS h FROM e JOIN z USING (vec_id) GROUP BY vec_id)
  SELECT vec_id, round(h, 5) AS entropy, round(embedding[label + 1]::DOUBLE - z, 5) AS logp FROM embeddings JOIN z USING (vec_id) JOIN h USING (vec_id)""")  # fmt: skip
def logits_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", F.round(tk.entropy("x"), 5).alias("entropy"), F.round(tk.log_prob("x", "label"), 5).alias("logp"))


@query("scaled_logits", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / 0.7::DOUBLE)), 5) AS total FROM embeddings")
def scaled_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(tk.total(tk.scale(F.col("embedding").cast("array<double>"), 0.7)), 5).alias("total"))


@query("entropy_loss", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings), z AS (SELECT vec_id, max(x) + ln(sum(exp(x))) - max(x) AS z FROM e GROUP BY vec_id),
  h AS (SELECT vec_id, any_value(label) AS label, any_value(z) - sum(exp(x - z) * x) AS h FROM e JOIN z USING (vec_id) GROUP BY vec_id) SELECT round(avg(h), 5) AS loss FROM h WHERE label <> 0""")  # fmt: skip
def entropy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") != 0).cast("int").alias("m"), tk.entropy(F.col("embedding").cast("array<double>")).alias("h"))
    return losses.agg_loss(rows, "h", "m", "vec_id", "token-mean").select(F.round("loss", 5).alias("loss"))


@query("chain_nodes", f"""WITH {T}, k AS (SELECT seq, pos, token, coalesce(sum((token IN (3, 9))::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM t),
  n AS (SELECT seq, min(pos) AS begin, count(*) AS size, sum(token) AS ids FROM k GROUP BY seq, part) SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY begin)::INT - 1 AS node, (begin + 2)::INT AS prompt_size, size::INT AS size, (7 + 8 + coalesce((SELECT sum(token) FROM t WHERE t.seq = n.seq AND t.pos < begin), 0))::BIGINT AS prompt_ids, ids::BIGINT AS ids FROM n""")  # fmt: skip
def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences cut after stop tokens: each node's prompt is the prompt and all that came before it."""
    nodes = tk.chain_nodes(F.array(F.lit(7).cast("long"), F.lit(8).cast("long")), F.col("token"), tk.spans_at_stops("token", (3, 9)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = sequences(spark, sf_dir, "token").select("seq", F.posexplode(nodes).alias("node", "n"))
    return rows.select("seq", "node", F.size("n.prompt").alias("prompt_size"), F.size("n.ids").alias("size"), total(F.col("n.prompt")).alias("prompt_ids"), total(F.col("n.ids")).alias("ids"))


@query("rollout_padded", f"""WITH {T}, s AS (SELECT seq, list(token ORDER BY pos) AS x, list(m ORDER BY pos) AS m FROM t GROUP BY seq), p AS (SELECT seq, x[:20] AS prompt, x[21:] AS response, m[21:] AS m FROM s),
  q AS (SELECT seq, list_concat([0 FOR i IN range(24 - len(prompt))], prompt) AS left_ids, list_concat([0 FOR i IN range(24 - len(prompt))], [1 FOR i IN prompt]) AS left_mask, list_concat(response[:48], [0 FOR i IN range(48 - least(48, len(response)))]) AS right_ids,
    list_concat(m[:48], [0 FOR i IN range(48 - least(48, len(response)))]) AS right_mask, least(48, len(response)) AS n, len(prompt) AS k FROM p)
  SELECT seq, array_to_string(list_concat(left_ids, right_ids), ' ') AS ids, array_to_string(right_mask, '') AS mask, array_to_string(list_concat([greatest(i - (24 - k), 0) FOR i IN range(24)], [k + least(i, greatest(n, 1) - 1) FOR i IN range(48)]), ' ') AS positions,
    CASE WHEN n > 0 THEN n::INT - 1 END AS reward_at, round(list_sum([0.5 * x FOR x IN right_mask]), 4)::DOUBLE AS advantage FROM q""")  # fmt: skip
def rollout_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as rectangles: prompts padded on the left to 24, responses on the right to 48; the reward on the last token, the advantage on all that count."""
    rows = sequences(spark, sf_dir, "token", "m").select("seq", F.slice("token", 1, 20).alias("prompt"), F.slice("token", 21, 1 << 30).alias("response"), F.slice("m", 21, 1 << 30).alias("m"))
    out = tk.rectangle(rows, "prompt", "response", "m", 24, 48)
    text = lambda c, by=" ": F.array_join(F.col(c).cast("array<string>"), by)
    given = F.transform("response_mask", lambda x: 0.5 * x)
    total = F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("seq", text("ids").alias("ids"), text("response_mask", "").alias("mask"), text("positions").alias("positions"), F.col("reward_at").cast("int").alias("reward_at"), total.alias("advantage"))
