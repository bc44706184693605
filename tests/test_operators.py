"""Rules that the queries over the driver's tables don't reach."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rillflow.functions import grading as g
from rillflow.functions import mathtext as mt
from rillflow.functions import tokens as tk
from rillflow.operators import advantages, balance, batches, losses, metrics
from rillflow.operators.registry import Registry
from rillflow.sources import datasets
from rillflow.streaming import pools


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_registry_rules():
    r = Registry("estimator")
    f, h = (lambda: 1), (lambda: 2)
    r.register("a")(f)
    r.register("a")(f)
    with pytest.raises(ValueError):
        r.register("a")(h)
    with pytest.raises(ValueError):
        r.get("A")
    loose = Registry("loss", strict=False)
    loose.register("a")(f)
    loose.register("a")(h)
    assert loose.get("a") is h


def test_groups_of_one(spark):
    rows = spark.createDataFrame([("a", 3.0, 5), ("b", 1.0, 2), ("b", 2.0, 2)], "uid string, reward double, length long")
    get = lambda name: {(r.uid, r.reward): r.advantage for r in advantages.compute_advantage(name, rows).collect()}
    assert get("grpo")[("a", 3.0)] == pytest.approx(3 / (1 + 1e-6))
    assert get("rloo")[("a", 3.0)] == 3.0
    assert get("opo")[("a", 3.0)] == 3.0
    with pytest.raises(Exception, match="two rollouts"):
        get("grpo_passk")
    with pytest.raises(ValueError):
        get("nothing")


def test_gae_ignores_values_of_masked_tokens(spark):
    rng = random.Random(1)
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    r = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0]
    v = [rng.random() for _ in mask]
    w = [x if m else rng.random() for x, m in zip(v, mask)]
    df = spark.createDataFrame([(r, v, w, mask)], "r array<double>, v array<double>, w array<double>, m array<int>")
    a, b = df.select(tk.gae("r", "v", "m", 0.9, 0.8), tk.gae("r", "w", "m", 0.9, 0.8)).first()
    nv, lg, out = 0.0, 0.0, []
    for t in reversed(range(len(mask))):
        d = r[t] + 0.9 * nv - v[t] + 0.72 * lg
        nv, lg = v[t] * mask[t] + (1 - mask[t]) * nv, d * mask[t] + (1 - mask[t]) * lg
        out.append(lg)
    assert a == pytest.approx(b) and a == pytest.approx(out[::-1])


def test_masked_mean_and_errors(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0, 4.0], [1, 0, 0, 1], [1, 0, 0, 0])], "v array<double>, m array<int>, n array<int>")
    assert df.select(tk.masked_mean("v", "m")).first()[0] == pytest.approx(2.5)
    with pytest.raises(Exception, match="two tokens"):
        df.select(tk.masked_var("v", "n")).collect()
    with pytest.raises(Exception, match="longer"):
        df.select(tk.fit("m", 2, 0)).collect()


def test_best_at_is_the_exact_expectation(spark):
    xs = [1.0, 2.0, 2.5, 4.0, 9.0]
    draws = list(itertools.product(xs, repeat=2))
    best, worst = one(spark, metrics.best_at(F.lit(xs), 2), metrics.best_at(F.lit(xs), 2, best=False))
    assert best == pytest.approx(sum(map(max, draws)) / 25) and worst == pytest.approx(sum(map(min, draws)) / 25)


def test_majority_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "B", 0.1), (1, 3, "A", 0.7)], "k int, i int, v string, x double")
    assert metrics.majority(rows, ["k"], "v", "x", "i").first().value == 0.9


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("method", list(balance.METHODS.values()))
def test_balance_keeps_items_and_counts(method, equal):
    rng = random.Random(2)
    lengths = [rng.randint(1, 500) for _ in range(64)]
    parts = method(lengths, 4, equal)
    sums = [sum(n for n, p in zip(lengths, parts) if p == k) for k in range(4)]
    assert max(sums) - min(sums) < 1000 and set(parts) == {0, 1, 2, 3}
    if equal:
        assert all(parts.count(k) == 16 for k in range(4))


def test_differencing_beats_greedy():
    lengths = [8, 7, 6, 5, 4]
    parts = balance.largest_differencing(lengths, 2)
    assert sorted(sum(n for n, p in zip(lengths, parts) if p == k) for k in range(2)) == [14, 16]


def test_union_errors_on_a_difference(spark):
    a = spark.createDataFrame([(0, 1.0)], "row_id long, x double")
    b = spark.createDataFrame([(0, 2.0)], "row_id long, x double")
    with pytest.raises(Exception, match="differs"):
        batches.union_columns(a, b).collect()
    with pytest.raises(ValueError):
        batches.chunk(a, 2, 3)
    with pytest.raises(ValueError):
        batches.rename(a, ["x"], [])
    assert batches.check_consistency(a, {"x": "int", "y": "int"}) == ["x: double, not int", "y: missing"]


def test_empty_batches(spark):
    empty = spark.createDataFrame([], "row_id long, x double")
    assert batches.renumber(empty).count() == 0
    assert batches.pad_to_divisor(empty, 4, 0)[1] == 0
    assert batches.repeat(empty, 3).count() == 0


@pytest.mark.parametrize("mode", ["token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"])
def test_agg_loss(spark, mode):
    rows = spark.createDataFrame([(1, 1.0, 1), (1, 3.0, 1), (1, 9.0, 0), (2, 5.0, 1)], "s int, x double, m int")
    want = {"token-mean": 3.0, "seq-mean-token-sum": 4.5, "seq-mean-token-mean": 3.5, "seq-mean-token-sum-norm": 2.25}[mode]
    assert losses.agg_loss(rows, "x", "m", "s", mode, 4).first().loss == pytest.approx(want)
    with pytest.raises(ValueError):
        losses.agg_loss(rows, "x", "m", "s", "other")


def test_answers(spark):
    assert one(spark, g.loose_number(F.lit("a 1,000. b .")))[0] == "1,000."
    assert one(spark, g.loose_number(F.lit("none")))[0] is None
    with pytest.raises(Exception, match="final answer"):
        one(spark, g.first_number(F.lit("none")))
    assert not one(spark, g.numeric_equal(F.lit(float("nan")), F.lit(1.0)))[0]
    assert one(spark, g.numeric_equal(F.lit(math.inf), F.lit(math.inf)))[0]
    with pytest.raises(Exception, match="no SCORE"):
        one(spark, g.judged(F.lit("SCORE: 9"), "SCORE", 4))


def test_math_text():
    assert mt.unboxed(mt.last_boxed("x \\boxed{1} \\boxed{\\frac{a}{b}} y")) == "\\frac{a}{b}"
    assert mt.last_boxed("\\boxed{1") is None and mt.last_boxed(None) is None
    assert mt.equal_answers("\\frac12", "\\dfrac{1}{2}") and mt.equal_answers("0.5", "1/2") and mt.equal_answers("x = 3", "3.0")
    assert mt.equal_answers("(1, 2)", "(1,2.0)") and not mt.equal_answers("(1,2)", "(1,3)") and not mt.equal_answers("2", None)
    assert mt.repeated_share("abc") < 0.2 < mt.repeated_share("ababababababab")
    assert mt.without_accents("éçÑ") == "ecN"


def test_chain_states():
    run = lambda *events: __import__("functools").reduce(lambda c, e: pools.chain_event(c, *e), events, pools.Chain())
    start = ("failure", 1, 0, 4, 0, True)
    assert run(start).state == pools.DEEPENING
    assert run(start, start).ignored == 1
    assert run(start, ("teacher", 2, 0, 0, 3, True)).state == pools.LEARNING
    assert run(start, ("teacher", 2, 0, 0, 0, True)).state == pools.ABANDONED  # no deeper than before
    assert run(start, ("teacher", 2, 0, 0, 3, False)).state == pools.ABANDONED
    learn = (start, ("teacher", 2, 0, 0, 3, True))
    assert run(*learn, ("observation", 3, 2, 4, 0, True)).state == pools.LEARNING
    assert run(*learn, ("observation", 3, 0, 4, 0, True)).state == pools.DEEPENING
    mastered = run(*learn, ("observation", 3, 4, 4, 0, True))
    assert mastered.state == pools.LEARNING and mastered.depths == [0]
    assert run(*learn, ("observation", 3, 4, 4, 0, True), ("observation", 4, 4, 4, 0, True)).state == pools.COMPLETED


def test_stream_equals_batch(spark, tmp_path):
    from rillflow.plans.state_queries import chain_events

    events = chain_events(spark.range(400).selectExpr("id as event_id", "id % 7 as user_id"))
    for i in range(4):
        events.where(f"step >= {100 * i} and step < {100 * (i + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    def each(batch, n):
        batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))

    run = pools.chains_stream(stream).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    last = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).drop("batch").collect(), key=lambda r: r.n):
        last[r.prompt] = tuple(r)[:-1]
    want = {r.prompt: tuple(r) for r in pools.chains_batch(events).collect()}
    assert last == want and len({r[1] for r in want.values()}) > 1


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "row_id long, step int, output string")
    datasets.write_steps(rows, str(tmp_path / "steps"))
    assert spark.read.json(str(tmp_path / "steps")).count() == 2
    datasets.save_batch(rows, str(tmp_path / "batch"), {"seed": "7"})
    back, meta = datasets.load_batch(spark, str(tmp_path / "batch"))
    assert back.count() == 2 and meta == {"seed": "7"}
    with pytest.raises(Exception, match="unknown role"):
        rows.select(datasets.loss_mask(F.col("output"))).collect()


def test_registered_functions_by_name_of_the_row(spark):
    from rillflow.operators.registry import Registry

    known = Registry("score")
    known.register("a")(lambda x: x + 1)
    rows = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "n string, x int")
    assert rows.where("n = 'a'").select(known.dispatch(F.col("n"), F.col("x"))).first()[0] == 2
    for wrong, said in (("n = 'b'", "unknown score b"), ("n is null", "unknown score null")):
        with pytest.raises(Exception, match=said):
            rows.where(wrong).select(known.dispatch(F.col("n"), F.col("x"))).collect()
