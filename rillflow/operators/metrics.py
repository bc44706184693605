"""Evaluation and training metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators import batches
from rillflow.operators.tables import cut


def long_form(one_row: DataFrame, *keys: str) -> DataFrame:
    """(keys, key, value) of a row of metrics."""
    names = [c for c in one_row.columns if c not in keys]
    return one_row.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([F.col(k) for k in keys], names, "key", "value")


def data_metrics(rows: DataFrame, most_length: int, prefix: str = "") -> DataFrame:
    """(key, value): mean, max and min of reward, prompt and response lengths and turns, and the share of rows at the length limit."""
    parts: list[Column] = []
    for name, column in (("reward", "reward"), ("prompt_length", "prompt_len"), ("response_length", "response_len"), ("num_turns", "turns")):
        if column in rows.columns:
            parts += [f(column).alias(f"{prefix}{name}/{kind}") for kind, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    total = F.col("prompt_len") + F.col("response_len")
    parts.append(F.avg((total >= most_length).cast("double")).alias(f"{prefix}total_length/clip_ratio"))
    return long_form(rows.agg(*parts))


def critic_metrics(rows: DataFrame, most_response: int, most_prompt: int, use_critic: bool = True) -> DataFrame:
    """(key, value) of sequences ``rows(reward, score, prompt_len, response_len, advantages, returns, values, mask)``, arrays a token: mean, max and min of scores, rewards,
    lengths and, over unmasked tokens, of advantages, returns and values, the critic's explained variance, and the shares of rows exactly at the length limits.
    Tokens are aggregated within their row first, so no row a token is shuffled."""
    named = {"advantages": "advantages", "returns": "returns"} | ({"values": "values"} if use_critic else {})
    parts: list[Column] = []
    for name, column in (("critic/score", "score"), ("critic/rewards", "reward"), ("response_length", "response_len"), ("prompt_length", "prompt_len")):
        parts += [f(column).alias(f"{name}/{kind}") for kind, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    parts += [F.avg((F.col("response_len") == most_response).cast("double")).alias("response_length/clip_ratio"), F.avg((F.col("prompt_len") == most_prompt).cast("double")).alias("prompt_length/clip_ratio")]
    kept = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c), F.col("mask")), lambda x: x["mask"] > 0), lambda x: x[c])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    judged = rows
    for name, c in named.items():
        judged = judged.withColumn(f"_{c}", kept(c))
        parts += [(F.sum(total(F.col(f"_{c}"))) / F.sum(F.size(f"_{c}"))).alias(f"critic/{name}/mean"), F.max(F.array_max(f"_{c}")).alias(f"critic/{name}/max"), F.min(F.array_min(f"_{c}")).alias(f"critic/{name}/min")]
    if use_critic:
        gap = F.zip_with("_returns", "_values", lambda a, b: a - b)
        square = lambda a: total(F.transform(a, lambda x: x * x))
        n = F.sum(F.size("_returns"))
        var = lambda a: (F.sum(square(a)) - F.sum(total(a)) * F.sum(total(a)) / n) / (n - 1)
        parts.append((1 - var(gap) / (var(F.col("_returns")) + 1e-5)).alias("critic/vf_explained_var"))
    return long_form(judged.agg(*parts))


def explained_variance(rows: DataFrame, returns: str, values: str) -> DataFrame:
    return rows.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def spread(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def reduce_maps(rows: DataFrame, metrics: str) -> DataFrame:
    """Mean by key over maps; keys that a map lacks don't count."""
    return rows.select(F.explode(metrics).alias("key", "value")).groupBy("key").agg(F.avg("value").alias("value"))


def timing_keys(timing: Column) -> Column:
    return F.transform_keys(timing, lambda k, _: F.concat(F.lit("timing_s/"), k))


def timing_per_token(timing: DataFrame, response_tokens: int | Column, all_tokens: int | Column) -> DataFrame:
    """Milliseconds a token: response tokens for ``gen``, all tokens for the rest."""
    n = F.when(F.col("key") == "gen", response_tokens).otherwise(all_tokens)
    return timing.select("key", (F.col("value") * 1000 / n).alias("value"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return F.struct(tokens.alias("total_num_tokens"), seconds.alias("time_per_step"), (tokens / (seconds * devices)).alias("throughput"))


def slowest(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Least, most and mean, and the first row of the largest value."""
    first = F.min(F.struct((-F.col(value)).alias("v"), *order))
    return rows.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), first.alias("_f")).select("least", "most", "mean", *[F.col(f"_f.{o}").alias(o) for o in order])


def best_at(values: Column, k: Column | int, best: bool = True) -> Column:
    """The expected best (or worst) of ``k`` draws with replacement from ascending ``values``."""
    n = F.size(values)
    kk = F.lit(k) if isinstance(k, int) else k
    high = lambda i: F.pow((i + 1) / n, kk) - F.pow(i / n, kk)
    low = lambda i: F.pow((n - i) / n, kk) - F.pow((n - i - 1) / n, kk)
    return F.aggregate(F.transform(values, lambda x, i: x * (high(i) if best else low(i))), F.lit(0.0), lambda a, x: a + x)


def majority(rows: DataFrame, keys: Sequence[str], vote: str, value: str, order: str) -> DataFrame:
    """The first value of the most common vote; of equal counts the vote that was seen first."""
    votes = rows.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, value)).alias("f"))
    top = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(f"f.{order}").alias("at"), F.col(f"f.{value}").alias("value"))).alias("t"))
    return top.select(*keys, (-F.col("t.n")).alias("votes"), F.col("t.value").alias("value"))


def sample_sizes(n: Column) -> Column:
    """2, 4, 8 … below n, and n."""
    powers = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n)).cast("int"), F.lit(1))), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.concat(F.filter(powers, lambda p: p < n), F.array(n.cast("int")))


def validation_metrics(rows: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """(source, metric, value): mean@N, std@N (population) and the exact expectations of best@k and worst@k, per prompt, then their means over prompts."""
    each = rows.groupBy(source, prompt).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("xs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("string")
    base = each.select(source, F.explode(F.array(F.struct(F.concat(F.lit("mean@"), n).alias("metric"), F.col("mean").alias("value")), F.struct(F.concat(F.lit("std@"), n).alias("metric"), F.col("std").alias("value")))).alias("m"))
    sized = each.where("n > 1").select(source, "xs", F.explode(sample_sizes(F.col("n"))).alias("k"))
    k = F.col("k").cast("string")
    ends = sized.select(source, F.explode(F.array(
        F.struct(F.concat(F.lit("best@"), k).alias("metric"), best_at(F.col("xs"), F.col("k")).alias("value")),
        F.struct(F.concat(F.lit("worst@"), k).alias("metric"), best_at(F.col("xs"), F.col("k"), best=False).alias("value")),
    )).alias("m"))
    return base.unionAll(ends).groupBy(source, "m.metric").agg(F.avg("m.value").alias("value"))


def bootstrap(rows: DataFrame, keys: Sequence[str], value: str, size: int, draws: int, seed: int, order: Sequence[str] = ()) -> DataFrame:
    """(keys, mean and population deviation of the resamples' mean, max and min): ``draws`` resamples of ``size`` values with replacement.

    A draw is a place in its group, by a hash of the group, the seed and its number; rows are numbered over all groups by ranges
    and only those that are drawn are fetched, so a group of any size is ``draws * size`` places, and no task holds it. Values are
    numbered in ``order``, else by size. Null values are left out; a group without values gives no row.
    """
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *[F.col(o) for o in order if o not in (*keys, value)])
    placed = batches.number(held, *keys, *(o if o != value else "_v" for o in order), *([] if value in order else ["_v"])).select(*keys, "_v", "row_id")
    groups = placed.groupBy(*keys).agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    drawn = groups.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], "_draw", "_k"))
    place = F.floor(F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("_n"))
    taken = drawn.withColumn("row_id", (F.col("_first") + place).cast("long")).drop("_first", "_n", "_k").join(placed.select("row_id", "_v"), "row_id")
    each = taken.groupBy(*keys, "_draw").agg(F.avg("_v").alias("mean"), F.max("_v").alias("max"), F.min("_v").alias("min"))
    return each.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in ("mean", "max", "min") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def keep_mixed_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose values differ, and groups of one."""
    w = Window.partitionBy(group)
    return rows.withColumn("_s", F.stddev_pop(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where("_s > 0 or _n = 1").drop("_s", "_n")


def first_groups(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the ``n`` least groups: groups are numbered by ranges and semi-joined."""
    chosen = batches.number(rows.select(group).distinct(), group).where(F.col("row_id") < n).select(group)
    return rows.join(chosen, group, "left_semi")


def filter_and_downsample(rows: DataFrame, group: str, accuracy: str, clipped: str, low: float, high: float, factor: int) -> DataFrame:
    """Groups with an accuracy within the band and no clipped row come first; 1 / ``factor`` of all groups stays, by a distributed rank."""
    each = rows.groupBy(group).agg(F.avg(accuracy).alias("a"), F.max(F.col(clipped).cast("int")).alias("c"))
    passing = (F.col("a") >= low) & (F.col("a") <= high) & (F.col("c") == 0)
    ranked = batches.number(each.select(group, F.when(passing, 0).otherwise(1).alias("_late")), "_late", group)
    chosen = ranked.where(F.col("row_id") < ranked.count() // factor).select(group)
    return rows.join(chosen, group, "left_semi")


def pair_accuracy(rows: DataFrame, group: str, item: str, score: str, accuracy: str) -> DataFrame:
    """Share of pairs with different accuracy that the score orders alike; 0.5 where all accuracies agree.

    Counted from ranks, without listing pairs: with two accuracies in a group, each positive row beats the negatives below it."""
    low = F.when(F.col(accuracy) < 0.5, 1.0).otherwise(0.0)
    upto = F.sum(low).over(Window.partitionBy(group).orderBy(score).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    r = rows.withColumn("_below", upto - F.sum(low).over(Window.partitionBy(group, score)))
    total = r.groupBy(group).agg(F.sum(low).alias("neg"), F.sum(1 - low).alias("pos"), F.sum(F.when(F.col(accuracy) >= 0.5, F.col("_below")).otherwise(0.0)).alias("won"))
    return total.select(group, F.when(F.col("neg") * F.col("pos") == 0, 0.5).otherwise(F.col("won") / F.greatest(F.col("neg") * F.col("pos"), F.lit(1.0))).alias("accuracy"))


def opposite_mean(rows: DataFrame, group: str, value: str, accuracy: str) -> DataFrame:
    """``opposite``: the mean value of the group's rows on the other side of accuracy 0.5; null if there are none."""
    w = Window.partitionBy(group)
    yes = F.col(accuracy) >= 0.5
    side = lambda c: F.avg(F.when(c, F.col(value))).over(w)
    return rows.withColumn("opposite", F.when(yes, side(~yes)).otherwise(side(yes)))


def pair_winner(rows: DataFrame, pair: str, item: str, score: str) -> DataFrame:
    """``wins``: whether a row has its pair's largest score; of equal ones the first."""
    w = Window.partitionBy(pair).orderBy(F.desc(score), item)
    return rows.withColumn("wins", F.row_number().over(w) == 1)


def running_best(rows: DataFrame, step: str, value: str) -> DataFrame:
    """``improved``: strictly above all earlier steps."""
    over = batches.running(rows, step, F.col(value), F.max, until=-1)
    return over.withColumn("improved", F.coalesce(F.col(value) > F.greatest("_before", "_here"), F.lit(True))).drop("_before", "_here")


def islands(rows: DataFrame, order: str, value: str, partition: str | None = None) -> DataFrame:
    """``place`` of each row in its run of equal values."""
    by = Window.partitionBy(*([partition] if partition else [])).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(by)).cast("int"), F.lit(1))
    run = rows.withColumn("_n", new).withColumn("_r", F.sum("_n").over(by))
    return run.withColumn("place", F.row_number().over(Window.partitionBy(*([partition] if partition else []), "_r").orderBy(order)) - 1).drop("_n", "_r")


def masked_mean_of_all(rows: DataFrame, value: str, mask: str) -> DataFrame:
    """(mean, n): the mean of masked-in values over all rows and tokens."""
    return rows.agg((F.sum(F.when(F.col(mask) != 0, F.col(value))) / F.count_if(F.col(mask) != 0)).alias("mean"), F.count_if(F.col(mask) != 0).alias("n"))


def reduce_timing(rows: DataFrame, name: str, seconds: str) -> DataFrame:
    """(name, seconds): each timer's mean over ranks."""
    return rows.groupBy(name).agg(F.avg(seconds).alias(seconds))


def response_info(rows: DataFrame, mask: str, responses: str) -> DataFrame:
    """``prompt_length`` and ``response_length``: masked-in tokens before and within the last ``size(responses)`` of a row's mask."""
    n = F.size(responses)
    ones = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x.cast("int"))
    head = F.slice(mask, F.lit(1), F.greatest(F.size(mask) - n, F.lit(0)))
    tail = F.slice(mask, F.greatest(F.size(mask) - n, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
    return rows.withColumn("prompt_length", ones(head)).withColumn("response_length", ones(tail))


def preference_metrics(rows: DataFrame, score: str, reward: str, logits: str, chosen: str, rejected: str, response: str, prompt: str, most_response: int, most_prompt: int) -> DataFrame:
    """(key, value) of preference training: scores, rewards, log-probabilities, lengths and how many were clipped."""
    stats = lambda k, c: [F.avg(c).alias(f"{k}/mean"), F.max(c).cast("double").alias(f"{k}/max"), F.min(c).cast("double").alias(f"{k}/min")]
    clipped = lambda k, c, most: F.avg((F.col(c) == most).cast("double")).alias(f"{k}/clip_ratio")
    one = rows.agg(
        *stats("reward/score", score), *stats("reward/rewards", reward), F.avg(logits).alias("actor/dpo_logits"), F.avg(chosen).alias("actor/chosen_logps"), F.avg(rejected).alias("actor/rejected_logps"),
        *stats("response_length", response), clipped("response_length", response, most_response), *stats("prompt_length", prompt), clipped("prompt_length", prompt, most_prompt),
    )
    return long_form(one)


def checkpoint_due(remaining: Column, longest_step: Column, save: float = 60.0, spare: float = 0.0) -> Column:
    """Whether another step and a checkpoint may not fit in the ``remaining`` seconds, which are still positive; without a deadline (null): no."""
    return F.coalesce((remaining > 0) & (longest_step > 0) & (remaining <= longest_step + save + spare), F.lit(False))


def detached_pair_loss(rows: DataFrame, group: str, score: str, accuracy: str, beta: float, best_of: str | None = None) -> DataFrame:
    """(loss): -log sigmoid of the gap between a row's scaled score and the mean of its group's rows on the other side of accuracy, with the sign of
    its own side; the mean over rows. ``best_of`` (a column): the sum instead, weighted by n * share(column <= own) ** (n - 1) within the group."""
    gap = beta * (F.col(score) - F.coalesce("opposite", F.lit(0.0)))
    signed = gap * F.when(F.col(accuracy) > 0, 1.0).otherwise(-1.0)
    loss = F.greatest(-signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
    judged = opposite_mean(rows, group, score, accuracy).withColumn("_loss", loss)
    if best_of is None:
        return judged.agg(F.avg("_loss").alias("loss"))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    share = F.cume_dist().over(Window.partitionBy(group).orderBy(best_of))
    return judged.withColumn("_w", n * F.pow(share, n - 1)).agg(F.sum(F.col("_loss") * F.col("_w")).alias("loss"))


def fit_logistic(rows: DataFrame, x: str, y: str, penalty: float = 1.0, rounds: int = 50) -> tuple[float, float] | None:
    """(slope, intercept) of P(y = 1) by Newton's method; five sums a round come to the driver. ``penalty * slope ** 2 / 2`` is added to the loss.

    Rows are counted by (x, y) into a table once, which each round reads: far fewer rows where x repeats, and as many where it
    doesn't. Null with ten rows or fewer, with one class only, or where x is (nearly) the same in all rows and no penalty holds the slope.
    """
    seen = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("int").alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    seen = cut(seen, "seen")
    counts = {r.y: r.n for r in seen.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if sum(counts.values()) <= 10 or not counts.get(0) or not counts.get(1):
        return None
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * F.col("x") + b)))
        g, h = F.col("n") * (p - F.col("y")), F.col("n") * p * (1 - p)
        s = seen.agg(F.sum(g).alias("gb"), F.sum(g * F.col("x")).alias("ga"), F.sum(h).alias("hb"), F.sum(h * F.col("x")).alias("hab"), F.sum(h * F.col("x") * F.col("x")).alias("ha")).first()
        ga, ha = s.ga + penalty * a, s.ha + penalty
        det = ha * s.hb - s.hab**2
        if det <= 1e-12 * max(1.0, ha * s.hb):
            return None
        da, db = (s.hb * ga - s.hab * s.gb) / det, (ha * s.gb - s.hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b
