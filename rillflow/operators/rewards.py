"""Reward managers: scorers over responses, token placement, and evaluation of stored responses."""

from __future__ import annotations

import importlib.util
import signal
from collections.abc import Callable
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rillflow.functions import grading as g
from rillflow.functions import tokens as tk
from rillflow.operators.registry import REWARD_MANAGERS

Scorer = Callable[[Column, Column], Column]


@REWARD_MANAGERS.register("naive")
def naive(rows: DataFrame, scorer: Scorer, response: str = "response", truth: str = "truth", mask: str = "mask") -> DataFrame:
    """``rewards``: the score on the last response token. Rows that come with ``rm_scores`` keep them.

    A scorer that gives a struct adds its other fields as columns."""
    score = scorer(F.col(response), F.col(truth))
    kind = rows.select(score.alias("s")).schema["s"].dataType
    out = rows.withColumn("_s", score)
    if hasattr(kind, "fieldNames"):
        out = out.withColumns({f: F.col(f"_s.{f}") for f in kind.fieldNames()})
        score = F.col(f"_s.{kind.fieldNames()[0]}")
    else:
        out, score = out.withColumn("reward", F.col("_s")), F.col("_s")
    made = g.reward_at_last(score, F.col(mask))
    return out.withColumn("rewards", F.coalesce(F.col("rm_scores"), made) if "rm_scores" in rows.columns else made).drop("_s")


@REWARD_MANAGERS.register("batch")
def batch(rows: DataFrame, function: Callable[[list[str], list[str]], list[float]], response: str = "response", truth: str = "truth") -> DataFrame:
    """``reward`` by a Python function of whole batches."""
    score = F.pandas_udf(lambda a, b: pd.Series(function(a.tolist(), b.tolist()), dtype=float), DoubleType())
    return rows.withColumn("reward", score(response, truth))


@REWARD_MANAGERS.register("prime")
def prime(rows: DataFrame, function: Callable[[str, str], float], response: str = "response", truth: str = "truth", seconds: float = 300.0) -> DataFrame:
    """``reward`` by a Python function of one response; one that raises, or takes more than ``seconds``, scores 0."""

    def late(*_: object) -> None:
        raise TimeoutError(f"no score within {seconds} seconds")

    def safe(a: str, b: str) -> float:
        # A worker scores in its main thread, where a timer may interrupt.
        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return float(function(a, b))
        except Exception:  # noqa: BLE001  a scorer's failure is a score of 0
            return 0.0
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    score = F.pandas_udf(lambda a, b: pd.Series([safe(x, y) for x, y in zip(a, b, strict=True)], dtype=float), DoubleType())
    return rows.withColumn("reward", score(response, truth))


@REWARD_MANAGERS.register("dapo")
def dapo(rows: DataFrame, scorer: Scorer, most: int, buffer: int, factor: float, response: str = "response", truth: str = "truth", length: str = "length") -> DataFrame:
    """``reward``: the score and the penalty of overlong responses."""
    return rows.withColumn("reward", scorer(F.col(response), F.col(truth)) + g.overlong_penalty(F.col(length), most, buffer, factor))


def offline_scores(rows: DataFrame, source: str, responses: str, truth: str, scorer: Scorer) -> DataFrame:
    """(source, score): the mean over rows of each row's mean score of its list of responses."""
    each = F.transform(responses, lambda r: scorer(r, F.col(truth)))
    return rows.select(source, (tk.total(each) / F.size(responses)).alias("score")).groupBy(source).agg(F.avg("score").alias("score"))


def token_rloo(rows: DataFrame, group: str, rewards: str, mask: str, n: int) -> DataFrame:
    """``advantages`` of token rewards: r n / (n - 1) - (sum of the group's masked means) / (n - 1) on masked-in tokens."""
    mean = tk.total(F.zip_with(rewards, mask, lambda r, m: r * m)) / F.when(tk.total(F.col(mask)) > 0, tk.total(F.col(mask)))
    base = F.sum("_mean").over(Window.partitionBy(group)) / (n - 1)
    out = rows.withColumn("_mean", mean).withColumn("_base", base)
    return out.withColumn("advantages", F.zip_with(rewards, mask, lambda r, m: m * (r * n / (n - 1) - F.col("_base")))).drop("_mean", "_base")


def implicit_rewards(logp: Column, ref: Column, beta: float) -> Column:
    """beta (logp - ref) by token."""
    return F.zip_with(logp, ref, lambda a, b: beta * (a - b))


def label_log_probs(logps: Column, labels: Column, average: bool = False) -> Column:
    """Sum, or mean, of the log-probabilities of labels other than -100."""
    kept = F.filter(F.zip_with(logps, labels, lambda p, y: F.when(y != -100, p)), lambda x: x.isNotNull())
    return tk.total(kept) / F.size(kept) if average else tk.total(kept)


def cross_entropy(scores: Column, accuracy: Column, mask: Column, beta: float) -> Column:
    """Binary cross-entropy of the sigmoid of the scaled score sum."""
    z = beta * tk.masked_sum(scores, mask)
    return F.greatest(z, F.lit(0.0)) - z * accuracy + F.log1p(F.exp(-F.abs(z)))


def sign_agreement(rows: DataFrame, scores: str, accuracy: str, mask: str) -> DataFrame:
    """Share of rows whose score sum has the sign of 2 acc - 1."""
    return rows.agg(F.avg((F.signum(tk.masked_sum(scores, mask)) == F.signum(2 * F.col(accuracy) - 1)).cast("double")).alias("accuracy"))


def teacher_gate(student: Column, teacher: Column, suffix: Column, reward: Column, least_match: int, least_ratio: float, least_suffix: int, most_tokens: int, room: int = 32, threshold: float = 0.0) -> Column:
    """Why a teacher's continuation isn't used (null: it is), the first reason that holds; and how long the common prefix is."""
    match = tk.common_prefix(student, teacher)
    total = match + F.size(suffix)
    why = (
        F.when(F.size(teacher) == 0, "no_response").when(match < least_match, "short_match").when((F.size(student) > 0) & (match / F.greatest(F.size(student), F.lit(1)) < least_ratio), "low_ratio")
        .when(F.size(suffix) < F.greatest(F.lit(least_suffix), F.lit(1)), "short_suffix").when(total > most_tokens, "too_long").when(most_tokens - total < room, "no_room").when(reward <= threshold, "low_reward")
    )
    return F.struct(match.alias("match"), why.alias("skip_reason"))


def load_scorer(path: str, name: str, **fixed: object) -> Callable:
    """The function ``name`` of the Python file at ``path``, with ``fixed`` keyword arguments bound; a missing file or name is an error."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no scorer file {path!r}")
    spec = importlib.util.spec_from_file_location(f"rillflow_scorer_{Path(path).stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path!r} has no {name!r}")
    return partial(getattr(module, name), **fixed) if fixed else getattr(module, name)


def load_manager(name: str, scorer: Callable | None = None, default: Callable | None = None, **fixed: object) -> Callable[[DataFrame], DataFrame]:
    """The reward manager of that name, with ``scorer``, or else ``default``, bound."""
    manager, chosen = REWARD_MANAGERS.get(name), scorer or default
    if chosen is None:
        raise ValueError(f"reward manager {name!r} needs a scorer")
    return lambda rows: manager(rows, chosen, **fixed)


def attach_teacher(students: DataFrame, teachers: DataFrame, key: str, least_match: int, least_ratio: float, least_suffix: int, most_tokens: int, room: int = 32, threshold: float = 0.0) -> DataFrame:
    """Every student row ``(key, ids, ...)`` with its tree's newest continuation of ``teachers(key, teacher, suffix, reward, step)``: ``match`` and
    ``skip_reason`` (``no_teacher`` without one; null if it is used), and ``ids`` of the used ones replaced by the common prefix and the suffix."""
    newest = teachers.groupBy(key).agg(F.max_by(F.struct("teacher", "suffix", F.col("reward").alias("teacher_reward")), "step").alias("_t"))
    both = students.join(newest, key, "left")
    gate = teacher_gate(F.col("ids"), F.col("_t.teacher"), F.col("_t.suffix"), F.col("_t.teacher_reward"), least_match, least_ratio, least_suffix, most_tokens, room, threshold)
    out = both.withColumn("_g", F.when(F.col("_t").isNotNull(), gate))
    out = out.withColumns({"match": F.coalesce("_g.match", F.lit(0)), "skip_reason": F.when(F.col("_t").isNull(), "no_teacher").otherwise(F.col("_g.skip_reason"))})
    used = F.col("skip_reason").isNull()
    return out.withColumn("ids", F.when(used, F.concat(F.slice("ids", F.lit(1), F.col("match")), "_t.suffix")).otherwise(F.col("ids"))).drop("_t", "_g")


def process_scores(logp: Column, ref: Column, n: Column, beta: float, lam: float = 0.0, accuracy: Column | None = None) -> Column:
    """Implicit rewards of the first ``n - 1`` of ``n`` tokens, zeros after them: scaled log-ratios, or with ``lam`` their sums from each token on,
    discounted by it. With ``accuracy`` the last token's reward is the accuracy less all rewards before it."""

    def judge(q: Column) -> Column:
        r = q
        if lam:
            before = F.aggregate(F.slice(q, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
            filled = F.transform(q, lambda x, i: F.when(i == n - 1, accuracy - before).otherwise(x)) if accuracy is not None else q
            r = tk.discounted_returns(filled, F.transform(filled, lambda _: F.lit(1)), lam)
        return F.transform(r, lambda x, i: F.when(i < n - 1, x).otherwise(0.0))

    return tk.let(F.zip_with(logp, ref, lambda a, b: (a - b) * beta).alias("q"), lambda q: tk.let(F.transform(q, lambda x, i: F.when(i < n, x).otherwise(0.0)), judge))


def node_score(finished: Column, source: Column, graders: dict[str | tuple[str, ...], Column], completed: Column) -> Column:
    """(reward, completed, finished) of a node: all 0 unless its response came to its end, else the score of its source's grader and whether an answer was found.
    An unfinished node needs no grader."""
    over = F.coalesce(finished, F.lit(False))
    return F.struct(F.when(over, by_source(source, graders)).otherwise(0.0).alias("reward"), F.when(over, completed.cast("int")).otherwise(0).alias("completed"), over.cast("int").alias("finished"))


def by_source(source: Column, graders: dict[str | tuple[str, ...], Column]) -> Column:
    """The score of the grader that a row's source names (one, or a tuple of names); an error for any other source."""
    out = F.raise_error(F.concat(F.lit("no grader for source "), F.coalesce(source, F.lit("null")))).cast("double")
    for names, score in reversed(graders.items()):
        out = F.when(source.isin(names) if isinstance(names, str) else source.isin(*names), score.cast("double")).otherwise(out)
    return out
