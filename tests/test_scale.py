"""What only shows beyond small tables: many wide rows, deep trees, scorers that hang."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rillflow.functions import grading as g
from rillflow.operators import batches, metrics, rewards, sampling, trees


def test_numbering_loses_no_row(spark):
    rows = spark.range(1_200_000).select(F.col("id").alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"), (F.col("id") % 7).alias("part"))
    out = batches.number(rows.repartition(13), "part", "key")
    got = out.agg(F.count(F.lit(1)), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id"), F.sum("key")).first()
    assert tuple(got) == (1_200_000, 1_200_000, 0, 1_199_999, 1_199_999 * 600_000)
    head = out.where("row_id in (0, 1, 171429)").orderBy("row_id").select("part", "key").collect()
    assert [tuple(r) for r in head] == [(0, 0), (0, 7), (1, 1)]


def test_mini_batches_and_resample_take_every_row(spark):
    rows = batches.number(spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 5).cast("double").alias("w")), "key")
    made = batches.mini_batches(rows, 300, 3, 1)
    assert [tuple(r) for r in made.groupBy("epoch").agg(F.count(F.lit(1)), F.countDistinct("row_id"), F.max("batch")).orderBy("epoch").collect()] == [(e, 5000, 5000, 16) for e in range(3)]
    drawn = sampling.resample(rows.drop("row_id"), "w", 4000, 2, "key")
    count = {r.w: r.n for r in drawn.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert drawn.count() == 4000 and 0.0 not in count and all(abs(n / 4000 - w / 10) < 0.05 for w, n in count.items())
    assert sampling.resample(rows.drop("row_id").limit(0), "w", 10, 2, "key").count() == 0


def test_trees_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)] + [("a", "b"), ("b", "c"), ("c", "b")]
    up = trees.closure(spark.createDataFrame(chain, "node string, parent string"))
    got = {(r.node, r.ancestor): r.distance for r in up.collect()}
    want = {(f"n{i}", f"n{j}"): i - j for i in range(150) for j in range(i + 1)}
    want |= {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("b", "b"): 0, ("b", "c"): 1, ("c", "c"): 0, ("c", "b"): 1}
    assert got == want


def brute_tree(rows, leaves):
    """Depth, root, what lies below and the path of every node, by walking; a cycle isn't followed."""
    parent = {}
    for n, p in rows:
        if p is not None:
            parent[n] = min(p, parent.get(n, p))
    ids = {n for n, _ in rows} | set(parent.values())
    depth, round_ = {}, set()
    for n in ids:
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        depth[n] = len(seen) - (at is None)
        round_ |= set(seen[seen.index(at) :]) if at is not None else set()
    parent = {n: p for n, p in parent.items() if n not in round_}
    paths, below = {}, {}
    for n in ids:
        at, path = n, []
        while at is not None:
            path.append(at)
            at = parent.get(at)
        paths[n] = path[::-1]
        for a in path:
            below.setdefault(a, []).append(n)
    return depth, paths, below


def test_ladders_against_walks(spark):
    rng = random.Random(6)
    rows = [(f"n{i}", f"n{rng.randrange(max(0, i - 3), i)}" if i else None) for i in range(60)] + [(f"s{i}", "n3") for i in range(40)]
    rows += [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "e"), ("f", "e"), ("g", "gone"), ("h", "n1"), ("h", "n0"), ("n5", None), ("z", None)]
    rewards = {n: rng.choice([None, 0.5, 1.0, 3.0]) for n, _ in rows if rng.random() < 0.6}
    depth, paths, below = brute_tree(rows, rewards)
    nodes, leaves = spark.createDataFrame(rows, "node string, parent string"), spark.createDataFrame(list(rewards.items()), "node string, reward double")
    own = {n for n, _ in rows}
    assert {r.node: r.depth for r in trees.depths(nodes).collect()} == {n: d for n, d in depth.items() if n in own}
    ladder = trees.Ladder(nodes)
    assert {r.node: r.root for r in ladder.roots().collect()} == {n: p[0] for n, p in paths.items()}
    want = {}
    for n, under in below.items():
        kept = [rewards[u] for u in under if u in rewards]
        known = [x for x in kept if x is not None]
        if kept:
            want[n] = (len(kept), pytest.approx(sum(known) / len(known)) if known else None)
    assert {r.node: (r.leaves, r.value) for r in trees.values(nodes, leaves).collect()} == want
    assert {r.node: r.path for r in trees.leaf_paths(nodes, leaves).collect()} == {n: paths[n] for n in rewards}
    for most in (0, 1, 3, 100):
        got = {r.node: (r.lineage, r.lineage_cut, r.descendants, r.deepest) for r in trees.contexts(nodes, most, ladder).collect()}
        assert got == {n: (paths[n][-most:] if most else [], max(0, depth[n] + 1 - most), len([u for u in below[n] if u in own]) - 1, max(depth[u] for u in below[n] if u in own)) for n in own}
    assert trees.depths(nodes.limit(0)).count() == trees.values(nodes.limit(0), leaves.limit(0)).count() == 0


def test_a_chain_and_a_star_of_200_000(spark):
    n = 200_000
    chain = spark.range(n).selectExpr("id as node", "if(id = 0, null, id - 1) as parent")
    star = spark.range(n).selectExpr("id + 1000000 as node", "if(id = 0, null, 1000000) as parent")
    nodes = chain.unionAll(star)
    ladder = trees.Ladder(nodes)
    assert len(ladder.jumps) == 18 and ladder.cycles is None
    deep = ladder.roots().groupBy("root").agg(F.max("depth").alias("d"), F.sum("depth").alias("s")).orderBy("root").collect()
    assert [tuple(r) for r in deep] == [(0, n - 1, n * (n - 1) // 2), (1_000_000, 1, n - 1)]
    valued = trees.values(nodes, nodes.selectExpr("node", "double(node % 2) as reward"), ladder)
    got = valued.where(f"node in (0, 1, {n - 1}, 1000000, 1000001)").orderBy("node").collect()
    assert [(r.node, r.leaves, round(r.value, 6)) for r in got] == [(0, n, 0.5), (1, n - 1, 0.500003), (n - 1, 1, 1.0), (1_000_000, n, 0.5), (1_000_001, 1, 1.0)]
    assert valued.where(f"node < {n} and leaves <> {n} - node").isEmpty()


def test_groups_are_ranked(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") % 3).cast("double").alias("a"), F.lit(False).alias("c"))
    assert sorted({r.g for r in metrics.first_groups(rows, "g", 7).collect()}) == list(range(7))
    assert metrics.filter_and_downsample(rows, "g", "a", "c", 0.0, 2.0, 4).select("g").distinct().count() == 10


def test_a_hung_scorer_scores_zero(spark):
    def scorer(a, b):
        while a == "hang":
            time.sleep(0.05)
        if a == "bad":
            raise ValueError(a)
        return float(a == b)

    rows = spark.createDataFrame([("x", "x"), ("hang", "x"), ("bad", "x"), ("y", "x")], "response string, truth string").coalesce(1)
    assert [r.reward for r in rewards.prime(rows, scorer, seconds=0.5).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_scorers_from_files(tmp_path):
    (tmp_path / "mine.py").write_text("def score(a, b, scale=1):\n    return scale * (a == b)\n")
    assert rewards.load_scorer(str(tmp_path / "mine.py"), "score", scale=3)("a", "a") == 3
    with pytest.raises(FileNotFoundError):
        rewards.load_scorer(str(tmp_path / "none.py"), "score")
    with pytest.raises(AttributeError):
        rewards.load_scorer(str(tmp_path / "mine.py"), "other")
    with pytest.raises(ValueError):
        rewards.load_manager("naive")


def test_table_answers(spark):
    cases = {"1,200 pages": "1200 pages", "3,000": "3000", "2 weeks": "14 days", "4.0": "4", "b | a": "a|b", "Crème, brûlée!": "brûlée!|crème", "Crème brûlée!": "creme brulee", None: "", " ": ""}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, want string")
    assert rows.select(g.table_answer(F.col("a")).alias("x"), "want").where("x != want").collect() == []
    pairs = [("12", "12 days", True), ("12", "13 days", False), ("a|b", "B, A", True), (None, "a", False), ("a", None, False), ("", "", True)]
    got = spark.createDataFrame(pairs, "a string, t string, want boolean").select(g.table_match(F.col("a"), F.col("t")).alias("x"), "want")
    assert got.where("x != want").collect() == []


def test_soundness_refuses_what_lacks(spark):
    good = '{"faithfulness": 4, "instruction_answering": 0, "analytical_depth": 1, "process_coherence": 2.5, "visualization": 3}'
    assert spark.range(1).select(g.soundness(F.lit(f"x ```json {good} ```")).alias("s")).first().s.process_coherence == 2.5
    for bad in (good.replace("4", "5"), good.replace("visualization", "other"), "no json"):
        with pytest.raises(Exception, match="no soundness scores"):
            spark.range(1).select(g.soundness(F.lit(bad)).alias("s")).collect()


def test_columns_and_maps_that_clash(spark):
    with pytest.raises(ValueError):
        batches.from_columns(spark, {"a": [1], "b": [1, 2]}, "a long, b long")
    with pytest.raises(Exception, match="two values for k"):
        spark.range(1).select(batches.union_maps(F.create_map(F.lit("k"), F.lit("1")), F.create_map(F.lit("k"), F.lit("2")))).collect()


def test_bootstrap_of_large_and_small_groups(spark):
    rows = spark.createDataFrame([("s", float(x)) for x in (1, 2, 3, 4, 5)] + [("one", 7.0), ("none", None)], "g string, v double")
    got = {r.g: r for r in metrics.bootstrap(rows, ["g"], "v", 3, 100, 42).collect()}
    assert set(got) == {"s", "one"}
    assert abs(got["s"].mean_mean - 3.0) < 0.3 and 3.5 < got["s"].max_mean < 5 and 1 < got["s"].min_mean < 2.5
    assert tuple(got["one"])[1:] == (7.0, 0.0, 7.0, 0.0, 7.0, 0.0)
    large = spark.range(1_000_000).selectExpr("'a' as g", "id * 1.0D as v").unionAll(rows)
    got = {r.g: r for r in metrics.bootstrap(large, ["g"], "v", 16, 400, 1).collect()}
    # A mean of 16 uniform values deviates by 1e6 / sqrt(12 * 16); its mean over 400 draws by a twentieth of that.
    assert abs(got["a"].mean_mean - 5e5) < 4 * 1e6 / (192**0.5 * 20) and abs(got["a"].mean_std / (1e6 / 192**0.5) - 1) < 0.15
    assert abs(got["a"].max_mean / 1e6 - 16 / 17) < 0.02


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_takes_all_rows(spark):
    rows = spark.range(1000).selectExpr("id as k", "id % 7 * 1.0D as s")
    for method in ("max_min", "max_random"):
        plan = plan_of(sampling.reweight(rows, "s", method))
        # The one row of the ends is aggregated by partial aggregates; no window takes the table.
        assert "Window" not in plan and plan.count("SinglePartition") == 1
    assert {r.s: r.weight for r in sampling.reweight(rows, "s", "max_min").collect()} == {0.0: 1.0, 6.0: 1.0, **{float(i): 0.0 for i in range(1, 6)}}
    with pytest.raises(ValueError, match="unknown reweighting"):
        sampling.reweight(rows, "s", "least")
    sample = sampling.bottom_k(rows, 5, 3, "k", group="s")
    assert {r["count"] for r in sample.groupBy("s").count().collect()} == {5}
    part = sampling.bottom_k(rows.where("k < 500"), 5, 3, "k", group="s")
    # Rows of the whole's sample that are in the part are in the part's sample.
    assert {r.k for r in sample.where("k < 500").collect()} <= {r.k for r in part.collect()}


def test_batches_are_compared_by_digests(spark):
    nan = float("nan")
    a = spark.createDataFrame([(0, 1.0, "x", [1.0, nan]), (1, nan, None, None), (2, -0.0, "y", [])], "row_id long, v double, t string, l array<double>")
    b = spark.createDataFrame([(2, 0.0, "y", []), (0, 1.0, "x", [1.0, nan]), (1, nan, None, None)], "row_id long, v double, t string, l array<double>")
    same = lambda x, y, **k: {r.column: r.equal for r in batches.equal_columns(x, y, "v", "t", "l", **k).collect()}
    assert same(a, b) == {"v": True, "t": True, "l": True}
    assert same(a, b, nan_equal=False) == {"v": False, "t": True, "l": False}
    assert same(a, b.where("row_id < 2")) == {"v": False, "t": False, "l": False}
    swapped = b.withColumn("row_id", F.expr("if(row_id = 0, 1, if(row_id = 1, 0, row_id))"))
    assert same(a, swapped) == {"v": False, "t": False, "l": False}
    assert batches.united(a, b.withColumn("w", F.lit(1))).columns == ["row_id", "v", "t", "l", "w"]
    with pytest.raises(ValueError, match="columns differ: v"):
        batches.united(a.drop("l"), b.drop("l"), nan_equal=False)
    ok = {r.check: r.ok for r in batches.consistency(a, {"v": "double", "u": "int"}).collect()}
    assert ok == {"v is double": True, "u is int": False, "row_id has no nulls": True, "row_id has no repeats": True, "row_id has no gaps": True, "l is equally long": False}


def test_columns_and_items_of_a_batch(spark):
    rows = batches.number(spark.range(10).selectExpr("id as k"), "k")
    one, two = rows.select("row_id", F.col("k").alias("value")), rows.select("row_id", (F.col("k") * 2).alias("value"))
    assert sorted(tuple(r) for r in batches.zipped({"a": one, "b": two}).collect()) == [(i, i, 2 * i) for i in range(10)]
    with pytest.raises(ValueError, match="different lengths"):
        batches.zipped({"a": one, "b": two.limit(3)})
    keys = lambda key: [r.k for r in batches.item(rows, key).orderBy("row_id").collect()]
    assert keys(-1) == [9] and keys([3, -2, 3]) == [3, 8, 3] and keys([True, False, True]) == [0, 2] and keys(slice(2, 8, 3)) == [2, 5] and keys(F.col("k") > 7) == [8, 9]
    with pytest.raises(IndexError):
        batches.item(rows, 10)


def test_shares_of_parts_that_do_not_divide(spark):
    parts = [batches.number(spark.range(n).selectExpr("id as k", f"{p} as p"), "k") for p, n in enumerate((10, 0, 3))]
    out = [tuple(r) for r in batches.interleaved(parts, [10, 0, 3], 4, {}).select("row_id", "worker", "p", "k").orderBy("row_id").collect()]
    assert [r[0] for r in out] == list(range(13))
    assert [r[1:] for r in out] == [(w, p, k) for w in range(4) for p, n in ((0, 10), (2, 3)) for k in range(w * n // 4, (w + 1) * n // 4)]
