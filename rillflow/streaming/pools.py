"""Curriculum pools as keyed state: transitions are plain functions on a state, run by ``applyInPandasWithState`` on a
stream, or folded over a table's events per key in a batch. Sampling over keys is a batch query on a snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.operators.batches import number
from rillflow.operators.sampling import weighted_without_replacement

LEARNING, DEEPENING, COMPLETED, ABANDONED = "learning", "deepening_requested", "completed", "abandoned"


@dataclass
class Chain:
    """A prompt's chain of prefixes: the depth of each node on the stack, and the counts of the active one."""

    state: str = ""
    depths: list[int] = field(default_factory=list)
    k_succ: int = 0
    k_total: int = 0
    step: int = -1
    ignored: int = 0


def chain_event(c: Chain, kind: str, step: int, k_succ: int, k_total: int, depth: int, success: bool) -> Chain:
    """A failure of the main rollout opens a chain; an observation learns, deepens or retreats; a teacher's answer
    pushes a deeper node or abandons. Events that don't fit the state are ignored and counted."""
    if kind == "failure":
        if c.state:
            c.ignored += 1
            return c
        return Chain(DEEPENING, [0], 0, 0, step)
    if kind == "observation" and c.state == LEARNING:
        c.k_succ, c.k_total, c.step = k_succ, k_total, step
        if k_total and k_succ == k_total:  # mastered: the stack's top goes, and the root completes
            c.depths.pop()
            c.state = LEARNING if c.depths else COMPLETED
            c.k_succ = c.k_total = 0
        elif k_succ == 0:
            c.state = DEEPENING
        return c
    if kind == "teacher" and c.state == DEEPENING:
        c.step = step
        if success and (not c.depths or depth > c.depths[-1]):
            c.depths.append(depth)
            c.state, c.k_succ, c.k_total = LEARNING, 0, 0
        else:
            c.state = ABANDONED
        return c
    c.ignored += 1
    return c


def sample_chains(chains: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` learning chains without replacement, in proportion to 4 p (1 - p) of their active node, 1 for an untried one."""
    p = F.col("k_succ") / F.when(F.col("k_total") > 0, F.col("k_total"))
    weighted = chains.where(F.col("state") == LEARNING).withColumn("_weight", F.when(p.isNull(), 1.0).otherwise(4 * p * (1 - p)))
    return weighted_without_replacement(weighted, "_weight", n, seed, "prompt").drop("_weight")


CHAIN_OUT = "prompt string, state string, depth int, nodes int, k_succ int, k_total int, step long, ignored int"
CHAIN_STATE = "state string, depths array<int>, k_succ int, k_total int, step long, ignored int"


def _chain_row(prompt: str, c: Chain) -> dict:
    return {"prompt": prompt, "state": c.state, "depth": c.depths[-1] if c.depths else -1, "nodes": len(c.depths), "k_succ": c.k_succ, "k_total": c.k_total, "step": c.step, "ignored": c.ignored}


def _fold(c: Chain, events: pd.DataFrame) -> Chain:
    for e in events.sort_values(["step", "seq"]).itertuples():
        c = chain_event(c, e.kind, int(e.step), int(e.k_succ), int(e.k_total), int(e.depth), bool(e.success))
    return c


def chains_batch(events: DataFrame) -> DataFrame:
    """The state of every prompt after all of ``events(prompt, step, seq, kind, k_succ, k_total, depth, success)``."""
    return events.groupBy("prompt").applyInPandas(lambda key, g: pd.DataFrame([_chain_row(key[0], _fold(Chain(), g))]), CHAIN_OUT)


def chains_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: the state of a prompt after each micro-batch that has events of it."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Chain(*state.get) if state.exists else Chain()
        c.depths = list(c.depths)
        c = _fold(c, pd.concat(list(parts)))
        state.update(tuple(asdict(c).values()))
        yield pd.DataFrame([_chain_row(key[0], c)])

    return events.groupBy("prompt").applyInPandasWithState(run, CHAIN_OUT, CHAIN_STATE, "update", GroupStateTimeout.NoTimeout)


# Snapshots of the forest: nodes(tree, node, parent, active, created, last_rollout, last_sft, k_succ, k_total), events(event, tree, parent, created, in_flight).


def observe(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes after ``seen(tree, node, k_succ, k_total, step)``, of which the last step of a node counts: all successes
    deactivate a node, a failure reactivates a root."""
    last = seen.groupBy("tree", "node").agg(F.max_by(F.struct("k_succ", "k_total"), "step").alias("s"), F.max("step").alias("at"))
    out = nodes.join(last, ["tree", "node"], "left")
    new = F.col("s.k_total").isNotNull()
    done = F.col("s.k_succ") == F.col("s.k_total")
    active = F.when(new & done, False).when(new & F.col("parent").isNull(), True).otherwise(F.col("active"))
    return out.withColumns({
        "active": active, "last_rollout": F.when(new, F.greatest("last_rollout", "at")).otherwise(F.col("last_rollout")),
        "k_succ": F.coalesce("s.k_succ", "k_succ"), "k_total": F.coalesce("s.k_total", "k_total"),
    }).drop("s", "at")


def failures(seen: DataFrame) -> DataFrame:
    """Teacher requests that an observation with failures queues."""
    return seen.where("k_succ < k_total").select(F.sha1(F.concat_ws(":", "tree", "node", "step")).alias("event"), "tree", F.col("node").alias("parent"), F.col("step").alias("created"), F.lit(False).alias("in_flight"))


def sample_trees(nodes: DataFrame, n: int, step: int, cooldown: int = 0) -> DataFrame:
    """At most ``n`` trees, least recently sampled, then oldest, then least key; of each its least recently rolled-out active child node. None twice a step."""
    ready = nodes.where("active and parent is not null").where((F.col("last_rollout") < step) & ((F.col("last_rollout") < 0) | (step - F.col("last_rollout") >= cooldown)))
    w = Window.partitionBy("tree").orderBy("last_rollout", "created", "node")
    trees = nodes.groupBy("tree").agg(F.max("last_rollout").alias("tree_last"), F.min("created").alias("tree_created"))
    one = ready.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.join(trees.where(F.col("tree_last") < step), "tree").orderBy("tree_last", "tree_created", "tree").limit(n)


def teacher_requests(events: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """At most ``n`` queued events, one a tree: trees, then parents, least recently used, then the newest event."""
    used = nodes.select("tree", F.col("node").alias("parent"), "last_rollout")
    trees = nodes.groupBy("tree").agg(F.max("last_rollout").alias("tree_last"))
    w = Window.partitionBy("tree").orderBy("last_rollout", F.desc("created"), "event")
    one = events.where("not in_flight").join(used, ["tree", "parent"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.join(trees, "tree").orderBy("tree_last", "tree").limit(n)


def teacher_outcomes(answers: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """``answers(event, prefix, suffix, success)`` with what becomes of each: stale, failed, invalid_prefix, duplicate, no_suffix or child."""
    known = answers.join(events.select("event", "tree", "parent"), "event", "left").join(nodes.select("tree", F.col("node").alias("parent"), F.col("ids").alias("parent_ids")), ["tree", "parent"], "left")
    have = nodes.select("tree", F.col("ids").alias("prefix"), F.lit(True).alias("dup"))
    known = known.join(have, ["tree", "prefix"], "left")
    longer = (F.size("prefix") > F.size("parent_ids")) & (F.slice("prefix", F.lit(1), F.size("parent_ids")) == F.col("parent_ids"))
    outcome = (
        F.when(F.col("parent_ids").isNull(), "stale").when(~F.col("success"), "failed").when(F.col("dup"), "duplicate").when(~longer, "invalid_prefix")
        .when(F.size("suffix") < 1, "no_suffix").otherwise("child")
    )
    return known.withColumn("outcome", outcome)


def cleanup(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes of trees that have an active node or an event."""
    alive = nodes.where("active").select("tree").unionAll(events.select("tree")).distinct()
    return nodes.join(alive, "tree", "left_semi")


def freeze(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Suffix nodes created within the inclusive window, least recently trained first."""
    return nodes.where("parent is not null").where(F.col("created").between(first, last)).orderBy("last_sft", "created", "tree", "node")


def sample_suffixes(nodes: DataFrame, n: int, per_tree: int = 1) -> DataFrame:
    w = Window.partitionBy("tree").orderBy("last_sft", "created", "node")
    return nodes.where("parent is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_tree).drop("_n").orderBy("last_sft", "created", "tree", "node").limit(n)


def round_robin_batches(nodes: DataFrame, size: int) -> DataFrame:
    """``batch``: rounds over trees, every batch of ``size`` nodes of distinct trees; what doesn't fill a batch is left out.

    A round has a row of every tree that is large enough, so places within rounds come from ranges of (round, tree), not from a window of a round."""
    turn = F.row_number().over(Window.partitionBy("tree").orderBy("created", "node"))
    placed = number(nodes.withColumn("round", turn), "round", "tree")
    rounds = placed.groupBy("round").agg(F.min("row_id").alias("_first"), (F.floor(F.count(F.lit(1)) / size) * size).alias("_full"))
    kept = placed.join(rounds, "round").withColumn("_p", F.col("row_id") - F.col("_first")).where("_p < _full")
    return kept.withColumn("batch", F.floor(F.col("_p") / size)).drop("_p", "_first", "_full", "row_id")


def pool_stats(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """(key, value) gauges of a snapshot."""
    a = nodes.agg(
        F.count_distinct("tree").alias("trees"), F.count(F.lit(1)).alias("nodes"), F.count_if("active").alias("active_nodes"), F.count_distinct(F.when(F.col("active"), F.col("tree"))).alias("active_trees"),
        F.count_if(F.col("parent").isNotNull()).alias("suffix_nodes"), F.count_if((F.col("k_total") > 0) & (F.col("k_succ") == F.col("k_total"))).alias("mastered"), F.sum("k_total").alias("rollouts"), F.sum("k_succ").alias("successes"),
    )
    b = events.agg(F.count(F.lit(1)).alias("events"), F.count_if("in_flight").alias("in_flight"))
    both = a.join(F.broadcast(b))
    return both.select(*[F.col(c).cast("double").alias(c) for c in both.columns]).unpivot([], both.columns, "key", "value")


# Gauges of a dashboard by the count they show, other names of the same, and names that show 0.
GAUGES = {
    "forest/num_trees": "trees", "forest/num_nodes": "nodes", "forest/active_nodes": "active", "forest/active_nonroot_nodes": "active_child", "forest/teacher_suffix_nodes": "suffixes", "forest/deactivated_nodes": "inactive",
    "teacher/events_queued": "queued", "teacher/events_dispatched": "dispatched", "teacher/events_in_flight": "in_flight", "teacher/events_succeeded": "success", "teacher/events_duplicate_dropped": "duplicate",
    "teacher/events_invalid": "invalid", "teacher/events_stale_parent_inactive": "inactive_parent", "teacher/events_failed": "failed", "teacher/events_stale": "stale", "teacher/events_cleared": "cleared",
    "sft/eligible_trees": "sft_trees", "sft/eligible_nodes": "sft_nodes", "sft/sampled_nodes": "sft_sampled", "sft/recorded_node_updates": "sft_updates",
    "prefix_any_success_rate": "child_rate", "root_any_success_rate": "root_rate",
    "forest_pool/trees": "trees", "forest_pool/active_trees": "ready_trees", "forest_pool/total_nodes": "nodes", "forest_pool/observed_root_nodes": "root_seen", "forest_pool/observed_nonroot_nodes": "child_seen",
    "forest_pool/pending_events": "events", "forest_pool/suffix_sft_nodes": "suffixes", "forest_pool/suffix_sft_candidate_nodes": "sft_nodes", "forest_pool/suffix_sft_updates_total": "sft_updates",
    "forest_pool/suffix_sft_sampled_cumulative": "sft_sampled", "forest_pool/rollout_retired_nodes": "inactive", "forest_pool/events_enqueued": "enqueued", "forest_pool/events_dispatched": "dispatched",
    "forest_pool/teacher_successes": "success", "forest_pool/teacher_failed": "failed", "forest_pool/teacher_stale": "stale", "forest_pool/teacher_cleared": "cleared", "forest_pool/duplicate_child": "duplicate", "forest_pool/invalid_child": "invalid",
}
ZEROS = (
    "sft/optimizer_steps", "forest_pool/solved_trees", "forest_pool/suffix_sft_maturation_steps", "forest_pool/suffix_sft_matured_nodes", "forest_pool/suffix_sft_matured_cumulative", "forest_pool/events_coalesced",
    "forest_pool/pruned_nodes", "forest_pool/solved_cumulative", "forest_pool/reactivated_cumulative", "forest_pool/rr_tree_queue_size",
)
#: What the log of a pool counts.
LOGGED = ("enqueued", "dispatched", "success", "duplicate", "invalid", "inactive_parent", "failed", "stale", "cleared", "sft_sampled")


def forest_stats(nodes: DataFrame, events: DataFrame, log: DataFrame) -> DataFrame:
    """(key, value) of all gauges: of the snapshot ``nodes`` (with ``suffixed``: a teacher's suffix is there, and ``sft_updates``), of the
    waiting ``events`` and of ``log(kind)``, one row for each thing that happened. Nodes are counted by tree first, so no distinct counts."""
    child, seen = F.col("parent").isNotNull(), F.col("k_total") > 0
    flags = {
        "nodes": F.lit(True), "active": F.col("active"), "active_child": F.col("active") & child, "suffixes": F.col("suffixed"), "inactive": ~F.col("active"), "sft_nodes": F.col("active") & child & F.col("suffixed"),
        "root_seen": seen & ~child, "child_seen": seen & child, "root_good": seen & ~child & (F.col("k_succ") > 0), "child_good": seen & child & (F.col("k_succ") > 0),
    }
    by_tree = nodes.groupBy("tree").agg(*[F.count_if(c).alias(k) for k, c in flags.items()], F.sum("sft_updates").alias("sft_updates"))
    rate = lambda good, all_: F.coalesce(F.try_divide(F.sum(good), F.sum(all_)), F.lit(0.0))
    counts = by_tree.agg(
        F.count(F.lit(1)).alias("trees"), *[F.sum(k).alias(k) for k in (*flags, "sft_updates")], F.count_if(F.col("active_child") > 0).alias("ready_trees"), F.count_if(F.col("sft_nodes") > 0).alias("sft_trees"),
        rate("root_good", "root_seen").alias("root_rate"), rate("child_good", "child_seen").alias("child_rate"),
    )
    waiting = events.agg(F.count(F.lit(1)).alias("events"), F.count_if("in_flight").alias("in_flight"), F.count_if(~F.col("in_flight")).alias("queued"))
    happened = log.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in LOGGED])
    one = counts.join(F.broadcast(waiting)).join(F.broadcast(happened))
    shown = {**{k: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for k, v in GAUGES.items()}, **{k: F.lit(0.0) for k in ZEROS}}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in shown.items()])).alias("g")).select("g.*")


def evict(entries: DataFrame, step: int, most_age: int, most: int, order: str = "seq") -> DataFrame:
    """Entries of at most ``most_age`` steps, and of these the newest ``most``."""
    return entries.where(step - F.col("step") <= most_age).orderBy(F.desc(order)).limit(most)


def last_write(usage: DataFrame, key: str, step: str, *values: str) -> DataFrame:
    """The values of each key's last step."""
    return usage.groupBy(key).agg(F.max(F.struct(step, *values)).alias("u")).select(key, "u.*")


def windowed_metrics(stream: DataFrame, ts: str, width: str, late: str, value: str, *keys: str) -> DataFrame:
    """Count and mean by event-time window; rows later than ``late`` are dropped."""
    by = [F.window(ts, width).alias("w"), *keys]
    return stream.withWatermark(ts, late).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def save_state(nodes: DataFrame, events: DataFrame, path: str) -> None:
    """A snapshot of a pool: its nodes and its queued events."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    events.write.mode("overwrite").parquet(f"{path}/events")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, events) of a snapshot; events that were with a teacher when it was taken are queued again."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/events").withColumn("in_flight", F.lit(False))


def epoch_phase(nodes: DataFrame, events: DataFrame, first: int, last: int, size: int, passes: int = 1) -> DataFrame:
    """(key, value) of an epoch's end: suffix nodes created within the inclusive window are frozen, all events cleared, trees without an active node
    cleaned, and the frozen nodes replayed ``passes`` times in batches of ``size`` distinct trees. With fewer trees than that the phase waits."""
    frozen = freeze(nodes, first, last)
    one = frozen.agg(F.count(F.lit(1)).alias("snapshot_nodes"), F.count_distinct("tree").alias("snapshot_trees"))
    cleared = events.agg(F.count(F.lit(1)).alias("events_cleared"), F.count_if(~F.col("in_flight")).alias("events_cleared_pending"), F.count_if("in_flight").alias("events_cleared_in_flight"))
    dead = nodes.groupBy("tree").agg(F.bool_or("active").alias("alive")).agg(F.count_if(~F.col("alive")).alias("trees_cleaned"))
    full = round_robin_batches(frozen, size).agg(F.count(F.lit(1)).alias("_taken"))
    rows = one.join(F.broadcast(cleared)).join(F.broadcast(dead)).join(F.broadcast(full))  # one row each
    ready = F.col("snapshot_trees") >= size
    sampled = F.when(ready, F.col("_taken") * passes).otherwise(0)
    rows = rows.withColumns({
        "sampled_entries": sampled, "sample_batches": (sampled / size).cast("long"), "dropped_entries": F.when(ready, F.col("snapshot_nodes") * passes - sampled).otherwise(0),
        "waiting_for_full_batch": (~ready & (F.col("snapshot_nodes") > 0)).cast("int"), "needed_for_next_batch": F.when(~ready & (F.col("snapshot_nodes") > 0), size - F.col("snapshot_trees")).otherwise(0),
    }).drop("_taken")
    return rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns]).unpivot([], rows.columns, "key", "value")


def debug_records(nodes: DataFrame, events: DataFrame, samples: DataFrame) -> DataFrame:
    """A record a sampled rollout ``samples(tid, tree, node, source, ...)``: its node, the node's parent, and how many teacher events wait there."""
    node = nodes.select("tree", "node", F.struct(*[c for c in nodes.columns if c not in ("tree", "node")]).alias("state"))
    waiting = events.groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("events"), F.count_if("in_flight").alias("in_flight"))
    return samples.join(node, ["tree", "node"], "left").join(waiting, ["tree", "node"], "left").fillna(0, ["events", "in_flight"]).withColumn("known", F.col("state").isNotNull())


def feedback(stream: DataFrame, path: str, checkpoint: str, react: Callable[[DataFrame], DataFrame]) -> None:
    """Calls ``react`` on every batch that a stream has now and appends its rows to the table at ``path``, a folder a batch: a batch that is run again replaces its folder."""

    def each(batch: DataFrame, n: int) -> None:
        react(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
