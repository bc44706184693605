"""Token-level penalties, losses and their aggregation, as expressions over one row for each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.tokens import clip
from rillflow.operators import batches
from rillflow.operators.registry import KL_CONTROLLERS, POLICY_LOSSES


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """kl/k1: difference; abs; mse/k2: half its square; low_var_kl/k3: exp(d) - d - 1 with d = ref - logp within 20, result within 10."""
    d = logp - ref
    back = clip(-d, -20.0, 20.0)
    kinds = {"kl": d, "abs": F.abs(d), "mse": 0.5 * d * d, "low_var_kl": clip(F.exp(back) - back - 1, -10.0, 10.0)}
    kinds |= {"k1": kinds["kl"], "k2": kinds["mse"], "k3": kinds["low_var_kl"]}
    if kind not in kinds:
        raise ValueError(f"unknown KL penalty {kind!r}")
    return kinds[kind]


def token_rewards(score: Column, old: Column, ref: Column, beta: float) -> Column:
    return score - beta * (old - ref)


def policy_loss(old: Column, new: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> dict[str, Column]:
    """Dual-clip surrogate: loss, whether the ratio clip acts, the KL estimate, and whether the lower clip acts."""
    step = clip(new - old, -20.0, 20.0)
    ratio = F.exp(step)
    plain, clipped = -advantage * ratio, -advantage * clip(ratio, 1 - low, 1 + high)
    worse = F.greatest(plain, clipped)
    floor = -advantage * dual
    bounded = F.least(floor, worse)
    return {
        "loss": F.when(advantage < 0, bounded).otherwise(worse),
        "clipped": (clipped > plain).cast("double"),
        "kl": -step,
        "clipped_low": ((worse > floor) & (advantage < 0)).cast("double"),
    }


def shaping_loss(logp: Column, advantage: Column, gamma: float = 0.1) -> Column:
    """-A p / (p + gamma)."""
    p = F.exp(logp)
    return -advantage * p / (p + gamma)


@POLICY_LOSSES.register("gpg")
def gpg_loss(logp: Column, advantage: Column) -> Column:
    return -logp * advantage


def value_loss(predicted: Column, value: Column, returns: Column, clip_range: float = 0.5) -> dict[str, Column]:
    bounded = clip(predicted, value - clip_range, value + clip_range)
    plain, held = (predicted - returns) * (predicted - returns), (bounded - returns) * (bounded - returns)
    return {"loss": 0.5 * F.greatest(plain, held), "clipped": (held > plain).cast("double")}


def agg_loss(tokens: DataFrame, loss: str, mask: str, sequence: str, mode: str, width: int | None = None) -> DataFrame:
    """One row, ``loss``: token-mean; or the mean over sequences of the token sum, the token mean, or the sum over ``width``."""
    m, x = F.col(mask).cast("double"), F.when(F.col(mask) != 0, F.col(loss)).otherwise(0.0)
    if mode == "token-mean":
        return tokens.agg((F.sum(x) / (F.sum(m) + 1e-8)).alias("loss"))
    each = tokens.groupBy(sequence).agg(F.sum(x).alias("_s"), F.sum(m).alias("_n"))
    modes = {
        "seq-mean-token-sum": F.avg("_s"),
        "seq-mean-token-mean": F.avg(F.when(F.col("_n") == 0, F.lit(float("nan"))).otherwise(F.col("_s") / F.greatest("_n", F.lit(1e-300)))),
        "seq-mean-token-sum-norm": F.sum("_s") / F.lit(float(width or 1)),
    }
    if mode not in modes:
        raise ValueError(f"unknown aggregation {mode!r}")
    return each.agg(modes[mode].alias("loss"))


def _covariance(tokens: DataFrame, logp: str, advantage: str, mask: str) -> DataFrame:
    """``cov``: (A - mean A)(logp - mean logp), means over the mask's tokens."""
    on = F.col(mask) != 0
    means = tokens.where(on).agg(F.avg(advantage).alias("_a"), F.avg(logp).alias("_l"))
    return tokens.join(F.broadcast(means)).withColumn("cov", (F.col(advantage) - F.col("_a")) * (F.col(logp) - F.col("_l"))).drop("_a", "_l")


@POLICY_LOSSES.register("clip_cov")
def clip_cov(tokens: DataFrame, low: float, high: float, ratio: float, order: list[Column], logp: str = "logp", advantage: str = "advantage", mask: str = "mask") -> DataFrame:
    """``keep`` 0 for max(1, floor(ratio * tokens)) of the tokens whose covariance lies between ``low`` and ``high``, first by ``order``, else 1.

    How many is known after one aggregation; the pick itself is a distributed rank by ``order`` (for example a hash)."""
    with_cov = _covariance(tokens, logp, advantage, mask)
    inside = (F.col(mask) != 0) & (F.col("cov") > low) & (F.col("cov") < high)
    n = with_cov.agg(F.greatest(F.lit(1), F.floor(F.count_if(F.col(mask) != 0) * ratio)).alias("n")).first()["n"]
    with_cov = with_cov.withColumn("_key", F.struct(*order))
    last = batches.number(with_cov.where(inside).select("_key"), "_key").where(F.col("row_id") < int(n)).agg(F.max("_key").alias("_last"))
    return with_cov.join(F.broadcast(last)).withColumn("keep", F.when(inside & (F.col("_key") <= F.col("_last")), 0).otherwise(1)).drop("_key", "_last")


@POLICY_LOSSES.register("kl_cov")
def kl_cov(tokens: DataFrame, ratio: float, order: list[Column], logp: str = "logp", advantage: str = "advantage", mask: str = "mask") -> DataFrame:
    """``penalised`` 1 for the max(1, floor(ratio * tokens)) tokens of largest covariance, ties by ``order``."""
    with_cov = _covariance(tokens, logp, advantage, mask)
    n = with_cov.agg(F.greatest(F.lit(1), F.floor(F.count_if(F.col(mask) != 0) * ratio)).alias("n")).first()["n"]
    with_cov = with_cov.withColumn("_key", F.struct((-F.col("cov")).alias("c"), *order))
    last = batches.number(with_cov.where(F.col(mask) != 0).select("_key"), "_key").where(F.col("row_id") < int(n)).agg(F.max("_key").alias("_last"))
    return with_cov.join(F.broadcast(last)).withColumn("penalised", ((F.col(mask) != 0) & (F.col("_key") <= F.col("_last"))).cast("int")).drop("_key", "_last")


def dpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0, reference_free: bool = False) -> Column:
    """-log sigmoid of the scaled margin with label smoothing, or the IPO square."""
    z = (pc - pr) - (F.lit(0.0) if reference_free else rc - rr)
    log_sigmoid = lambda x: -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
    if kind == "sigmoid":
        return -log_sigmoid(beta * z) * (1 - smoothing) - log_sigmoid(-beta * z) * smoothing
    if kind == "ipo":
        return (z - 1 / (2 * beta)) * (z - 1 / (2 * beta))
    raise ValueError(f"unknown preference loss {kind!r}")


def softmean(rows: DataFrame, group: str, value: str, beta: float) -> DataFrame:
    """(log-sum-exp(beta x) - log n) / beta by group; the mean for beta 0."""
    if beta == 0:
        return rows.groupBy(group).agg(F.avg(value).alias("softmean"))
    top = rows.withColumn("_t", F.max(beta * F.col(value)).over(Window.partitionBy(group)))
    return top.groupBy(group).agg(((F.max("_t") + F.log(F.sum(F.exp(beta * F.col(value) - F.col("_t")))) - F.log(F.count(F.lit(1)))) / beta).alias("softmean"))


def sppo_loss(tokens: DataFrame, sequence: str, old: str, new: str, reward: str, mask: str, eta: float) -> DataFrame:
    """(sum of log ratios - eta r)^2 by sequence."""
    step = F.sum((F.col(new) - F.col(old)) * F.col(mask))
    return tokens.groupBy(sequence).agg(((step - eta * F.max(reward)) * (step - eta * F.max(reward))).alias("loss"))


@KL_CONTROLLERS.register("fixed")
def fixed_kl(steps: DataFrame, start: float) -> DataFrame:
    return steps.withColumn("beta", F.lit(start))


@KL_CONTROLLERS.register("adaptive")
def adaptive_kl(steps: DataFrame, start: float, target: float, horizon: float, step: str = "step", kl: str = "kl", n: str = "n") -> DataFrame:
    """``beta`` after each step: times 1 + clip(kl / target - 1, 0.2) n / horizon. A running product, by logarithms: their multiples of 2^-40, whose sums are
    exact up to 2^13, and the small rests are added apart, so that the error doesn't grow with the steps."""
    log = F.log(1 + clip(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n) / horizon)
    high = F.rint(log * 2.0**40) / 2.0**40
    over = batches.running(steps, step, (high, log - high), F.sum)
    both = [F.coalesce(F.col("_before")[i] + F.col("_here")[i], F.col("_before")[i], F.col("_here")[i]) for i in (0, 1)]
    return over.withColumn("beta", start * F.exp(both[0] + both[1])).drop("_before", "_here")
