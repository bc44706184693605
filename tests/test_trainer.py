"""Training rows, process scores, phases and fits against plain loops."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import balance, metrics, rewards, sampling, trees
from rillflow.sources import datasets
from rillflow.streaming import pools


def test_packages_skip_empty_paths_and_null_segments(spark):
    nodes = spark.createDataFrame([("r", None, None, 9.0), ("a", "r", [1, 2], 0.5), ("b", "a", [3, 4, 5], -1.0), ("c", "r", [], 2.0), ("d", "r", None, 2.0)], "node string, parent string, ids array<int>, process double")
    leaves = spark.createDataFrame([("b", 1.0), ("c", 0.0), ("d", None)], "node string, reward double")
    got = trees.packages(nodes, leaves, 4).collect()
    assert [(r.node, r.ids, r.advantages, r.advantage) for r in got] == [("b", [1, 2, 3, 4], [0.5, 0.5, -1.0, -1.0], -0.25)]


def test_teachers_are_joined_and_refused(spark):
    students = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2]), (None, [7])], "tree int, ids array<int>")
    teachers = spark.createDataFrame([(1, [1, 2, 9], [8, 8], 1.0, 5), (1, [1], [6], 1.0, 4), (2, [3], [4], 1.0, 1)], "tree int, teacher array<int>, suffix array<int>, reward double, step int")
    got = {r.tree: (r.match, r.skip_reason, r.ids) for r in rewards.attach_teacher(students, teachers, "tree", 1, 0.5, 1, 50, 1).collect()}
    assert got == {1: (2, None, [1, 2, 8, 8]), 2: (0, "short_match", [1, 2]), None: (0, "no_teacher", [7])}


@pytest.mark.parametrize("lam", [0.0, 0.7])
@pytest.mark.parametrize("truth", [False, True])
def test_process_scores_equal_a_loop(spark, lam, truth):
    rng, rows = random.Random(4), []
    for i in range(12):
        size = rng.randint(1, 7)
        rows.append((i, [rng.uniform(-3, 0) for _ in range(size)], [rng.uniform(-3, 0) for _ in range(size)], rng.randint(1, size), float(i % 2)))
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, n int, acc double")
    got = df.select("id", rewards.process_scores(F.col("a"), F.col("b"), F.col("n"), 0.5, lam, F.col("acc") if truth else None).alias("r")).collect()
    for (_, a, b, n, acc), r in zip(rows, sorted(got), strict=True):
        q = [0.5 * (x - y) if i < n else 0.0 for i, (x, y) in enumerate(zip(a, b, strict=True))]
        want = list(q)
        if lam:
            if truth:
                q[n - 1] = acc - sum(q[: n - 1])
            run = 0.0
            for i in reversed(range(len(q))):
                run = q[i] + lam * run
                want[i] = run
        want = [x if i < n - 1 else 0.0 for i, x in enumerate(want)]
        assert r.r == pytest.approx(want)


def test_sources_without_grader_are_errors(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "source string")
    graders = {("a", "c"): F.lit(1.0), "b": F.lit(0)}
    assert sorted(r.s for r in rows.select(rewards.by_source(F.col("source"), graders).alias("s")).collect()) == [0.0, 1.0]
    for other in ("z", None):
        with pytest.raises(Exception, match="no grader"):
            spark.createDataFrame([(other,)], "source string").select(rewards.by_source(F.col("source"), graders)).collect()


def test_logistic_fit_is_a_minimum(spark):
    rng = random.Random(2)
    data = [(x, int(rng.random() < 1 / (1 + math.exp(-(2 * x - 1))))) for x in (rng.random() for _ in range(300))]
    a, b = metrics.fit_logistic(spark.createDataFrame(data, "x double, y int"), "x", "y")
    x, y = np.array(data).T
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(np.sum((p - y) * x) + a) < 1e-6 and abs(np.sum(p - y)) < 1e-6
    assert metrics.fit_logistic(spark.createDataFrame([(0.1, 1)] * 30, "x double, y int"), "x", "y") is None
    assert metrics.fit_logistic(spark.createDataFrame([], "x double, y int"), "x", "y") is None
    # One x for all, and nothing that holds the slope.
    assert metrics.fit_logistic(spark.createDataFrame([(0.5, i % 2) for i in range(20)], "x double, y int"), "x", "y", penalty=0.0) is None


def test_branches_follow_their_weights(spark):
    nodes = spark.range(4000).selectExpr("id as chain", "explode(sequence(0, 3)) as place", "4 as length")
    taken = sampling.branch_utility(nodes, "chain", "place", "length", F.col("place") > 0, 1, 3, (4.0, -2.0), 0.5)
    counts = {r.place: r["count"] / 4000 for r in taken.groupBy("place").count().collect()}
    weights = {i: math.sqrt((i + 1) / 4) / (1 + math.exp(-(4 * (i + 1) / 4 - 2))) for i in (1, 2, 3)}
    assert counts == pytest.approx({i: w / sum(weights.values()) for i, w in weights.items()}, abs=0.03)


def test_detached_loss_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(i // 4, rng.choice([0.1, 0.5, 0.5, 0.9]), rng.randint(0, 1)) for i in range(32)]
    df = spark.createDataFrame(rows, "uid int, s double, acc int")
    plain = weighted = 0.0
    for u, s, acc in rows:
        mates = [r for r in rows if r[0] == u]
        other = [r[1] for r in mates if r[2] != acc]
        gap = 0.5 * (s - (sum(other) / len(other) if other else 0.0)) * (1 if acc else -1)
        loss = math.log1p(math.exp(-gap))
        plain += loss / len(rows)
        weighted += loss * 4 * (sum(r[1] <= s for r in mates) / 4) ** 3
    assert metrics.detached_pair_loss(df, "uid", "s", "acc", 0.5).first().loss == pytest.approx(plain)
    assert metrics.detached_pair_loss(df, "uid", "s", "acc", 0.5, "s").first().loss == pytest.approx(weighted)


def test_micro_batches_hold_every_row(spark):
    rows = spark.range(60).selectExpr("id % 3 as batch", "id as item", "id % 11 + 1 as length")
    assigned = balance.micro_batch_rows(rows, "batch", "item", "length", 40)
    assert assigned.count() == 60
    assert balance.reordered(assigned, "batch", "item").groupBy("batch").agg(F.count_distinct("place").alias("n"), F.max("place").alias("m")).where("n <> 20 or m <> 19").isEmpty()


def test_epoch_phase_waits_for_trees(spark):
    nodes = spark.createDataFrame([("t", 1, None, True, 5, -1, -1), ("t", 2, 1, True, 6, -1, -1), ("u", 3, None, False, 5, -1, -1)], "tree string, node long, parent long, active boolean, created long, last_rollout long, last_sft long")
    events = spark.createDataFrame([("e", "t", True)], "event string, tree string, in_flight boolean")
    got = {r.key: r.value for r in pools.epoch_phase(nodes, events, 0, 9, 2).collect()}
    assert (got["waiting_for_full_batch"], got["needed_for_next_batch"], got["sampled_entries"], got["trees_cleaned"], got["events_cleared_in_flight"]) == (1, 1, 0, 1, 1)
    none = {r.key: r.value for r in pools.epoch_phase(nodes.limit(0), events.limit(0), 0, 9, 2).collect()}
    assert set(none.values()) == {0.0}


def test_a_metric_step_is_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "key string, value double")
    datasets.append_metrics(rows, str(tmp_path), 1)
    datasets.append_metrics(rows.withColumn("value", F.col("value") + 1), str(tmp_path), 1)
    datasets.append_metrics(rows, str(tmp_path), 2)
    assert sorted((r.step, r.value) for r in spark.read.parquet(str(tmp_path)).collect()) == [(1, 2.0), (2, 1.0)]


def test_parts_without_items_take_no_memory():
    """As many micro-batches as a large table needs: sets of partial sums hold only what isn't empty."""
    rng = random.Random(4)
    lengths = [rng.randint(1, 50) for _ in range(20_000)]
    parts = -(-sum(lengths) // 300)
    tracemalloc.start()
    sums = Counter()
    for part, n in zip(balance.largest_differencing(lengths, parts), lengths, strict=True):
        sums[part] += n
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert len(sums) == parts and sum(sums.values()) == sum(lengths) and max(sums.values()) - min(sums.values()) < 50
