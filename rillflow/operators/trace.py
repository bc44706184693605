"""Tracing: what passed each operator of a query, observed as it runs."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Trace:
    """Operators that took part, in order, with their arguments; their numbers come from the jobs that run them anyway (``DataFrame.observe``), no job of their own.

    ``attributes`` name a run: a step, a sample or the like. Numbers of an operator are there once an action has run its result to the end; ``table``
    waits for them, so it is called after the action. An operator whose plan is run several times counts its first run."""

    attributes: dict[str, str] = field(default_factory=dict)
    calls: list[tuple[str, str, Observation]] = field(default_factory=list)

    def watch(self, df: DataFrame, name: str, inputs: str = "", **metrics: Column) -> DataFrame:
        """``df``, whose rows are counted and ``metrics`` aggregated as they pass."""
        seen = Observation(f"{len(self.calls)}:{name}")
        self.calls.append((name, inputs, seen))
        return df.observe(seen, F.count(F.lit(1)).cast("double").alias("rows"), *[m.cast("double").alias(n) for n, m in metrics.items()])

    def op(self, **metrics: Column) -> Callable:
        """Decorates a function that returns a table: each call is watched under its name; arguments that aren't tables are noted."""

        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            @functools.wraps(f)
            def run(*args, **kwargs) -> DataFrame:
                bound = inspect.signature(f).bind(*args, **kwargs)
                bound.apply_defaults()
                plain = {k: v for k, v in bound.arguments.items() if isinstance(v, (str, int, float, bool))}
                return self.watch(f(*args, **kwargs), f.__name__, ", ".join(f"{k}={v}" for k, v in plain.items()), **metrics)

            return run

        return wrap

    def table(self, spark: SparkSession) -> DataFrame:
        """(call, op, inputs, metric, value, attributes) of all watched operators."""
        rows = [(i, name, inputs, m, v if v is None else float(v), self.attributes) for i, (name, inputs, seen) in enumerate(self.calls) for m, v in seen.get.items()]
        return spark.createDataFrame(rows, "call int, op string, inputs string, metric string, value double, attributes map<string,string>")
