"""Samples whose randomness is a hash of the row and a seed, so that a rerun, or another engine, draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """In (0, 1): 48 bits of an md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def weighted_without_replacement(rows: DataFrame, weight: str, n: int, seed: int, *keys: str) -> DataFrame:
    """The ``n`` rows of largest ln(u) / w; weights of 0 or less come last."""
    w = F.col(weight)
    key = F.when(w > 0, F.log(uniform(seed, *keys)) / F.when(w > 0, w).otherwise(1.0)).otherwise(F.lit(float("-inf")))
    return rows.withColumn("_key", key).orderBy(F.desc("_key"), *keys).limit(n).drop("_key")


def success_weight(k: Column, n: Column) -> Column:
    """4 p (1 - p): at least 0.2 if all failed, 0.01 if all succeeded, 1e-5 untried."""
    p = k / F.when(n > 0, n)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1e-5).when(k == 0, 0.2).when(k == n, 0.01).otherwise(4 * p * (1 - p))


def capped(rows: DataFrame, group: str, cap: int, *order: Column | str) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def round_robin(rows: DataFrame, group: str, n: int, seed: int, *keys: str) -> DataFrame:
    """A stratified sample: groups in turn, each in its own random order."""
    u = rows.withColumn("_u", uniform(seed, *keys))
    lap = F.row_number().over(Window.partitionBy(group).orderBy("_u", *keys))
    return u.withColumn("lap", lap).orderBy("lap", "_u", *keys).limit(n).drop("_u")


def priority_laps(rows: DataFrame, group: str, step: str, n: int, *keys: str) -> DataFrame:
    """Groups by their newest row, newest first, in laps; last in, first out within a group."""
    newest = F.max(step).over(Window.partitionBy(group))
    lap = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(step), *[F.desc(k) for k in keys]))
    return rows.withColumn("newest", newest).withColumn("lap", lap).orderBy("lap", F.desc("newest"), group).limit(n)


def resample(rows: DataFrame, weight: str, n: int, seed: int, *order: str) -> DataFrame:
    """``n`` draws with replacement in proportion to a weight. Draws and the places where rows begin, on the line of running
    weights, are one sequence: a draw takes the last row that began before it, by a running maximum over ranges, and fetches it by number."""
    from rillflow.operators.batches import number, running

    placed = number(rows.where(F.col(weight) > 0), *order)
    upto = running(placed.select("row_id", F.col(weight).cast("double").alias("_w")), "row_id", F.col("_w"), F.sum)
    starts = upto.select((F.coalesce("_before", F.lit(0.0)) + F.col("_here") - F.col("_w")).alias("_x"), F.col("row_id").alias("_row"), F.lit(None).cast("long").alias("draw"))
    total = placed.agg(F.sum(F.col(weight).cast("double")).alias("_t"))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total)).where("_t > 0")
    both = starts.unionByName(draws.select((uniform(seed, "draw") * F.col("_t")).alias("_x"), F.lit(None).cast("long").alias("_row"), "draw"))
    taken = running(both, "_x", F.col("_row"), F.max).where("draw is not null").select("draw", F.greatest("_before", "_here").alias("row_id"))
    return taken.join(placed, "row_id").drop("row_id")


def reweight(rows: DataFrame, score: str, method: str, power: float = 1.0, name: str = "weight") -> DataFrame:
    """Rows with the weights of a preference resample: |score| ** power (``pow``), 1 at the least or largest score and 0 elsewhere (``max_min``), or 0.4 at
    the largest and 0.1 elsewhere (``max_random``). The ends are aggregated and joined as one row, so no task sees all rows."""
    s = F.col(score)
    if method == "pow":
        return rows.withColumn(name, F.pow(F.abs(s), F.lit(power)))
    if method not in ("max_min", "max_random"):
        raise ValueError(f"unknown reweighting {method!r}")
    ends = rows.agg(F.max(s).alias("_most"), F.min(s).alias("_least"))
    out = rows.join(F.broadcast(ends))
    w = F.when((s == F.col("_most")) | (s == F.col("_least")), 1.0).otherwise(0.0) if method == "max_min" else F.when(s == F.col("_most"), 0.4).otherwise(0.1)
    return out.withColumn(name, w).drop("_most", "_least")


def shown(rows: DataFrame, text: str, n: int, seed: int) -> DataFrame:
    """``n`` rows to look at, by a seeded hash of their text and then the text."""
    return rows.withColumn("_u", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(text)))).orderBy("_u", text).limit(n).drop("_u")


def bottom_k(rows: DataFrame, n: int, seed: int, *keys: str, group: str | None = None, salts: int = 32) -> DataFrame:
    """The ``n`` rows of least seeded hash of their keys, of all or of each group: the same rows however the table is cut, and of any part of it those that would be of the whole.

    Tasks keep ``n`` rows (a group and salt) and merge them, so no group is gathered."""
    u = rows.withColumn("_u", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
    if group is None:
        return u.orderBy("_u", *keys).limit(n).drop("_u")
    for by in ([group, F.pmod(F.xxhash64("_u"), F.lit(salts))], [group]):
        u = u.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_u", *keys))).where(F.col("_n") <= n).drop("_n")
    return u.drop("_u")


def prefixes(rows: DataFrame, tokens: str, step: int = 1) -> DataFrame:
    """A row for each place at which a branch may start, every ``step`` tokens but the end: ``place``, ``ratio`` (place + 1 of the length) and the ``prefix`` up to it."""
    size = F.size(tokens)
    places = F.when(size > 1, F.sequence(F.lit(0), size - 2, F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn("place", F.explode(places))
    return out.withColumns({"ratio": (F.col("place") + 1) / size, "prefix": F.slice(tokens, 1, F.col("place") + 1)}).drop(tokens)


def branch_points(nodes: DataFrame, chain: str, node: str, expandable: Column, n: int, seed: int) -> DataFrame:
    """Up to ``n`` expandable nodes of each chain, uniformly by a seeded hash."""
    return capped(nodes.where(expandable).withColumn("_u", uniform(seed, chain, node)), chain, n, "_u", node).drop("_u")


def branch_utility(nodes: DataFrame, chain: str, place: str, length: str, expandable: Column, n: int, seed: int, model: tuple[float, float] | None = None, bias: float = 0.1) -> DataFrame:
    """Up to ``n`` expandable nodes of each chain without replacement, in proportion to P(success) * ratio ** bias; ratio is (place + 1) / length,
    and P a logistic ``model(slope, intercept)`` of it, 1 without a model."""
    ratio = (F.col(place) + 1) / F.col(length)
    success = F.lit(1.0) if model is None else 1 / (1 + F.exp(-(model[0] * ratio + model[1])))
    weighted = nodes.where(expandable).withColumn("weight", success * F.pow(ratio, F.lit(bias)))
    return capped(weighted.withColumn("_key", F.log(uniform(seed, chain, place)) / F.col("weight")), chain, n, F.desc("_key"), place).drop("_key")
