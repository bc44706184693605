"""Running values over all steps, by ranges, against a loop."""

import math
import random

import pytest

from rillflow.operators import losses, metrics
from rillflow.plans import catalog, estimates, metric_queries  # noqa: F401
from tests.test_oracle import DATA


def test_running_best_and_adaptive_kl_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 500, None if i % 11 == 0 else rng.random() + i / 300) for i in range(600)]
    mixed = rng.sample(rows, len(rows))
    df = spark.createDataFrame(mixed, "step long, value double").repartition(5)
    best, want = None, {}
    for step, v in rows:
        want[step] = True if best is None or v is None else v > best
        best = best if v is None else v if best is None else max(best, v)
    got = metrics.running_best(df, "step", "value")
    assert {r.step: r.improved for r in got.collect()} == want and got.columns == [*df.columns, "improved"]
    beta, betas = 0.2, {}
    for step, v in rows:
        beta *= 1 + max(-0.2, min(0.2, (v or 0) / 0.06 - 1)) * 64 / 10000
        betas[step] = beta
    made = losses.adaptive_kl(df.na.fill(0.0).selectExpr("step", "value as kl", "64 as n"), 0.2, 0.06, 10000.0)
    assert all(math.isclose(r.beta, betas[r.step], rel_tol=1e-9) for r in made.collect()) and made.count() == 600
    assert metrics.running_best(df.limit(0), "step", "value").count() == 0


def test_adaptive_kl_stays_exact_over_many_steps(spark):
    n, log = 170_000, [math.log(1 + max(-0.2, min(0.2, (i / 100) / 0.06 - 1)) * 64 / 10000) for i in range(17)]
    steps = spark.range(n).selectExpr("id as step", "(id % 17) / 100.0D as kl", "64 as n")
    got = losses.adaptive_kl(steps, 0.2, 0.06, 10000.0).where("step % 9973 = 0").collect()
    for r in got:
        whole, rest = divmod(r.step + 1, 17)
        assert math.isclose(r.beta, 0.2 * math.exp(math.fsum([whole * math.fsum(log), *log[:rest]])), rel_tol=1e-12), r
    assert len(got) == 18


@pytest.mark.parametrize("name", ["running_best", "adaptive_kl"])
def test_all_events_count(spark, name):
    """By ranges: no window over all rows in one task."""
    df = catalog.QUERIES[name](spark, DATA)
    assert df.count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert df._jdf.queryExecution().executedPlan().toString().count("SinglePartition") <= 1
