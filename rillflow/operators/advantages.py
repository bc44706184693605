"""Advantages of rollouts within their groups: one window for each estimator, no self join.

Each estimator takes rows with a group, a reward and a response length, and adds ``advantage``; ``broadcast`` spreads
it over a token mask. Groups of one follow the estimator's own rule, as the sample deviation of one row is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.registry import ESTIMATORS

EPSILON = 1e-6


def _w(group: str) -> object:
    return Window.partitionBy(group)


@ESTIMATORS.register("grpo")
def grpo(rows: DataFrame, group: str = "uid", reward: str = "reward", by_std: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """(r - mean) / (sample deviation + epsilon); a group of one has mean 0 and deviation 1. ``by_std=False`` only centres."""
    w, r = _w(group), F.col(reward)
    one = F.count(F.lit(1)).over(w) == 1
    centred = r - F.when(one, 0.0).otherwise(F.avg(r).over(w))
    scaled = centred / (F.when(one, 1.0).otherwise(F.stddev_samp(r).over(w)) + epsilon)
    return rows.withColumn("advantage", scaled if by_std else centred)


@ESTIMATORS.register("grpo_passk")
def grpo_passk(rows: DataFrame, group: str = "uid", reward: str = "reward", order: tuple[str, ...] = (), by_std: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """The best row of a group gets best - second (over the deviation); others 0. Ties go to the first by ``order``. Groups of one are an error."""
    w, r = _w(group), F.col(reward)
    top = Window.partitionBy(group).orderBy(F.desc(reward), *order)
    gap = r - F.lead(r).over(top)
    if by_std:
        gap = gap / (F.stddev_samp(r).over(w) + epsilon)
    best = F.when(F.row_number().over(top) == 1, gap).otherwise(F.lit(0.0))
    alone = F.count(F.lit(1)).over(w) == 1
    return rows.withColumn("advantage", F.when(alone, F.raise_error(F.lit("pass@k needs two rollouts in every group")).cast("double")).otherwise(best))


@ESTIMATORS.register("rloo")
def rloo(rows: DataFrame, group: str = "uid", reward: str = "reward") -> DataFrame:
    """Leave-one-out: (r - mean) n / (n - 1); a group of one keeps r."""
    w, r = _w(group), F.col(reward)
    n = F.count(F.lit(1)).over(w)
    return rows.withColumn("advantage", F.when(n == 1, r).otherwise((r - F.avg(r).over(w)) * n / F.greatest(n - 1, F.lit(1))))


@ESTIMATORS.register("opo")
def opo(rows: DataFrame, group: str = "uid", reward: str = "reward", length: str = "length") -> DataFrame:
    """r less the group's length-weighted mean; a group of one has baseline 0."""
    w, r, n = _w(group), F.col(reward), F.col(length).cast("double")
    base = F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(F.sum(n * r).over(w) / F.sum(n).over(w))
    return rows.withColumn("advantage", r - base)


@ESTIMATORS.register("gpg")
def gpg(rows: DataFrame, group: str = "uid", reward: str = "reward", f_norm: float = 1.0) -> DataFrame:
    """alpha (r - mean) / f_norm with alpha = rows / max(1, rows of nonzero reward); a group of one has mean 0."""
    w, r = _w(group), F.col(reward)
    total = rows.agg((F.count(F.lit(1)) / F.greatest(F.count_if(r != 0), F.lit(1))).alias("alpha"))
    base = F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(F.avg(r).over(w))
    return rows.withColumn("_centred", r - base).join(F.broadcast(total)).withColumn("advantage", F.col("alpha") * F.col("_centred") / f_norm).drop("_centred", "alpha")


@ESTIMATORS.register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(rows: DataFrame, group: str = "uid", reward: str = "reward", length: str = "length") -> DataFrame:
    """Group-centred rewards (a group of one: baseline 0), whitened over all response tokens: each row weighs its length."""
    w, r = _w(group), F.col(reward)
    centred = rows.withColumn("_c", r - F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(F.avg(r).over(w)))
    n, c = F.col(length).cast("double"), F.col("_c")
    sums = centred.agg(F.sum(n).alias("_n"), F.sum(n * c).alias("_s"), F.sum(n * c * c).alias("_q"))
    mean = F.col("_s") / (F.col("_n") + 1e-8)
    # Mean squared distance from that mean, with Bessel's correction on the token count.
    around = (F.col("_q") - 2 * mean * F.col("_s") + mean * mean * F.col("_n")) / (F.col("_n") + 1e-8)
    var = around * F.col("_n") / (F.col("_n") - 1)
    return centred.join(F.broadcast(sums)).withColumn("advantage", (F.col("_c") - mean) / F.sqrt(var + 1e-8)).drop("_c", "_n", "_s", "_q")


@ESTIMATORS.register("sibling_mean")
def sibling_mean(rows: DataFrame, group: str = "uid", reward: str = "reward") -> DataFrame:
    """r less the mean of all siblings, itself included; no deviation."""
    return rows.withColumn("advantage", F.col(reward) - F.avg(reward).over(_w(group)))


def compute_advantage(name: str, rows: DataFrame, **parameters: object) -> DataFrame:
    """The estimator of that name; an unknown name is an error."""
    return ESTIMATORS.get(name)(rows, **parameters)


def broadcast_over(advantage: Column, mask: Column) -> Column:
    """A row's advantage on every token, times the mask."""
    return F.transform(mask, lambda m: m * advantage)


def keep_nonzero(rows: DataFrame, advantages: str = "advantages") -> DataFrame:
    """Rows whose summed absolute advantage is above 1e-8."""
    return rows.where(F.aggregate(advantages, F.lit(0.0), lambda a, x: a + F.abs(x)) > 1e-8)


def snis_weights(rows: DataFrame, group: str = "uid", advantage: str = "advantage", teacher: str = "teacher", beta: float = 1.0) -> DataFrame:
    """``weight``: exp((A_teacher - max A) / beta) over the mean of exp((A - max A) / beta) of students and teacher."""
    w, a = _w(group), F.col(advantage)
    shifted = F.exp((a - F.max(a).over(w)) / beta)
    return rows.withColumn("_e", shifted).withColumn("weight", F.when(F.col(teacher), F.col("_e") / F.avg("_e").over(w))).drop("_e")
