"""Trees as adjacency tables (node, parent), of any depth: a ladder of jumps, and aggregates that climb it.

A ladder has, for each k, the ancestor 2**k steps up of every node that has one. What lies below a node within 2**(k + 1)
steps is what lies within 2**k steps of it and of the nodes 2**k steps below, so an aggregate of all descendants takes a
join and an aggregation of as many rows as there are nodes for each k: the logarithm of the depth in rounds, for a chain
as for a star. Only paths that a caller asks for are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.tables import cut

#: Rounds after which an aggregate or a walk is written.
ROUNDS = 6


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of every node, itself at 0. By doubling: a round joins what lies within ``reach`` steps to what lies
    ``reach`` steps up, so a chain of any length takes the logarithm of its length in rounds. On a cycle each ancestor counts once, at its least distance."""
    edges = cut(nodes.select("node", "parent").where("parent is not null").distinct(), "jumps")
    most = edges.count()
    ids = nodes.select("node").unionAll(edges.select(F.col("parent").alias("node"))).distinct()
    up = cut(ids.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")), "closure")
    jump, reach = edges.select("node", F.col("parent").alias("to")), 1
    while reach <= most and not jump.isEmpty():
        further = jump.join(up.select(F.col("node").alias("to"), "ancestor", "distance"), "to").select("node", "ancestor", (F.col("distance") + reach).alias("distance"))
        up = cut(up.unionAll(further).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "closure")
        jump = cut(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")).distinct(), "jumps")
        reach *= 2
    return up.join(nodes.select("node").distinct(), "node", "left_semi")


class Ladder:
    """Jumps of ``nodes(node, parent)``. Of several parents of a node the least counts; a parent needs no row of its own.

    Nodes of a cycle have no root. They count as roots of what hangs on them: the cycle isn't followed, but in depths,
    which count the steps until a node repeats.
    """

    def __init__(self, nodes: DataFrame):
        edges = cut(nodes.where("parent is not null").groupBy("node").agg(F.min("parent").alias("to")), "edges")
        self.ids = cut(nodes.select("node").unionAll(edges.select(F.col("to").alias("node"))).distinct(), "ids")
        self.own = nodes.select("node").distinct()
        most = edges.count()
        self.jumps, self.cycles = self._doubled(edges, most), None
        if self.jumps and 2 ** (len(self.jumps) - 1) >= most:
            # Steps enough to have left every tree: who still gets somewhere is on a cycle there.
            round_ = cut(self.jumps[-1].select(F.col("to").alias("node")).distinct(), "cycles")
            self.cycles = self._lengths(edges.join(round_, "node"))
            self.jumps = self._doubled(cut(edges.join(round_, "node", "left_anti"), "edges"), most)

    @staticmethod
    def _twice(jump: DataFrame) -> DataFrame:
        return cut(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")), "jumps")

    def _doubled(self, jump: DataFrame, most: int) -> list[DataFrame]:
        """Jumps of 1, 2, 4 … steps, up to the first that no node has, or that has more than ``most``."""
        out = []
        while not jump.isEmpty():
            out.append(jump)
            if 2 ** (len(out) - 1) >= most:
                break
            jump = self._twice(jump)
        return out

    def _lengths(self, edges: DataFrame) -> DataFrame:
        """(node, length) of the nodes of cycles: each takes the least name on its cycle."""
        jump, least, reach, most = edges, cut(edges.select("node", F.least("node", "to").alias("least")), "least"), 1, edges.count()
        while reach < most:
            least = cut(least.join(jump, "node").join(least.select(F.col("node").alias("to"), F.col("least").alias("_far")), "to").select("node", F.least("least", "_far").alias("least")), "least")
            jump, reach = self._twice(jump), 2 * reach
        return cut(least.join(least.groupBy("least").agg(F.count(F.lit(1)).alias("length")), "least").select("node", "length"), "cycles")

    def roots(self) -> DataFrame:
        """(node, root, depth) of every node and parent."""
        out = self.ids.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
        for i, k in enumerate(reversed(range(len(self.jumps))), 1):
            up = self.jumps[k].select(F.col("node").alias("root"), F.col("to").alias("_far"))
            out = out.join(up, "root", "left").select("node", F.coalesce("_far", "root").alias("root"), (F.col("depth") + F.when(F.col("_far").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
            out = cut(out, "roots") if i % ROUNDS == 0 else out
        if self.cycles is not None:
            out = out.join(self.cycles.withColumnRenamed("node", "root"), "root", "left").select("node", "root", (F.col("depth") + F.coalesce("length", F.lit(0))).alias("depth"))
        return out

    def below(self, rows: DataFrame, **how: str) -> DataFrame:
        """(node, a column for each of ``how``): sum, min or max of the columns of ``rows(node, …)`` over a node and all below it; nodes with no row there or below are left out."""
        aggregates = {"sum": F.sum, "min": F.min, "max": F.max}
        merge = lambda df: df.groupBy("node").agg(*[aggregates[a](c).alias(c) for c, a in how.items()])
        out = merge(rows)
        for k, jump in enumerate(self.jumps, 1):
            # A row goes on at its node and at the ancestor that it jumps to.
            places = F.explode(F.array_compact(F.array("node", "to")))
            out = merge(out.join(jump, "node", "left").select(places.alias("node"), *how))
            out = cut(out, "below") if k % ROUNDS == 0 else out
        return out

    def lineage(self, starts: DataFrame, most: int | None = None) -> DataFrame:
        """(node, ancestor, distance) of every node of ``starts`` and its ancestors, itself at 0; ``most`` of them at most."""
        out = starts.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
        levels = [k for k in reversed(range(len(self.jumps))) if most is None or 1 << k < most]
        for i, k in enumerate(levels, 1):
            up = self.jumps[k].select(F.col("node").alias("ancestor"), F.col("to").alias("_far"))
            here, there = F.struct("ancestor", "distance"), F.struct(F.col("_far").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
            both = F.when(F.col("_far").isNull(), F.array(here)).otherwise(F.array(here, there))
            out = out.join(up, "ancestor", "left").select("node", F.explode(both).alias("p")).select("node", "p.*")
            out = cut(out, "lineage") if i % ROUNDS == 0 else out
        return out if most is None else out.where(F.col("distance") < most)


def depths(nodes: DataFrame) -> DataFrame:
    ladder = Ladder(nodes)
    return ladder.roots().select("node", F.col("depth").cast("int").alias("depth")).join(ladder.own, "node", "left_semi")


def values(nodes: DataFrame, leaves: DataFrame, ladder: Ladder | None = None) -> DataFrame:
    """(node, leaves, value): how many leaves lie below a node, and their mean reward. ``leaves(node, reward)``; leaves without a reward count, but not in the mean."""
    rows = leaves.select("node", F.lit(1).cast("long").alias("leaves"), F.coalesce("reward", F.lit(0.0)).alias("total"), F.when(F.col("reward").isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    out = (ladder or Ladder(nodes)).below(rows, leaves="sum", total="sum", n="sum")
    return out.select("node", "leaves", (F.col("total") / F.nullif("n", F.lit(0))).alias("value"))


def process_rewards(nodes: DataFrame, valued: DataFrame, root_of: DataFrame) -> DataFrame:
    """(node, process): (V - V of the root + V - V of the parent) / sqrt(leaves). ``root_of(node, root)``."""
    v = valued.select("node", "leaves", "value")
    parent = valued.select(F.col("node").alias("parent"), F.col("value").alias("pv"))
    root = valued.select(F.col("node").alias("root"), F.col("value").alias("rv"))
    out = nodes.join(v, "node").join(parent, "parent").join(root_of, "node").join(root, "root")
    return out.select("node", ((2 * F.col("value") - F.col("rv") - F.col("pv")) / F.sqrt("leaves")).alias("process"))


def leaf_paths(nodes: DataFrame, leaves: DataFrame, ladder: Ladder | None = None) -> DataFrame:
    """(node, path): from the root down to each leaf."""
    up = (ladder or Ladder(nodes)).lineage(leaves)
    packed = up.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("p"))
    return packed.select("node", F.col("p.ancestor").alias("path"))


def chains(parts: DataFrame, chain: str, order: str, ids: str, reward: str) -> DataFrame:
    """One row a chain: its parts' ids end to end, and the last part's reward."""
    packed = parts.groupBy(chain).agg(F.sort_array(F.collect_list(F.struct(order, ids, reward))).alias("p"))
    return packed.select(chain, F.flatten(F.col(f"p.{ids}")).alias(ids), F.element_at(F.col(f"p.{reward}"), -1).alias(reward))


def entropy_candidates(tokens: DataFrame, sequence: str, order: list[str], logp: str, n: int, skip: float = 0.05, tail: int = 10) -> DataFrame:
    """The ``n`` tokens of least log-probability past the first ``skip`` share and ``tail`` or more from the end."""
    w = Window.partitionBy(sequence)
    placed = tokens.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    return placed.where((F.col("pos") >= F.ceil(F.col("size") * skip)) & (F.col("pos") < F.col("size") - tail)).orderBy(logp, sequence, "pos").limit(n)


def deepest(nodes: DataFrame, n: int, ladder: Ladder | None = None) -> DataFrame:
    """The ``n`` nodes of largest (depth, children, key)."""
    ladder = ladder or Ladder(nodes)
    depth = ladder.roots().select("node", F.col("depth").cast("int").alias("depth")).join(ladder.own, "node", "left_semi")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return depth.join(kids, "node", "left").fillna(0, ["children"]).orderBy(F.desc("depth"), F.desc("children"), F.desc("node")).limit(n)


def contexts(nodes: DataFrame, most_lineage: int, ladder: Ladder | None = None) -> DataFrame:
    """(node, depth, lineage, lineage_cut, descendants, deepest): the last ``most_lineage`` nodes of the path from the root, how many were cut,
    how many nodes lie below and the largest depth among them and the node."""
    ladder = ladder or Ladder(nodes)
    depth = cut(ladder.roots().select("node", F.col("depth").cast("int").alias("depth")).join(ladder.own, "node", "left_semi"), "depths")
    below = ladder.below(depth.select("node", F.lit(1).cast("long").alias("descendants"), F.col("depth").alias("deepest")), descendants="sum", deepest="max")
    near = ladder.lineage(ladder.own, most_lineage).groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("p"))
    out = depth.join(below, "node").join(near, "node", "left")
    return out.select("node", "depth", F.coalesce(F.col("p.ancestor"), F.array().cast("array<string>")).alias("lineage"), F.greatest(F.col("depth") + 1 - most_lineage, F.lit(0)).alias("lineage_cut"), (F.col("descendants") - 1).alias("descendants"), "deepest")


def packages(nodes: DataFrame, leaves: DataFrame, most: int, ladder: Ladder | None = None) -> DataFrame:
    """(node, reward, ids, advantages, advantage): a training row a leaf. The segments ``nodes(node, parent, ids, process)`` from the root down, end
    to end, at most ``most`` tokens; a token's advantage is its segment's process reward. Paths without tokens are left out, a null segment is empty."""
    up = (ladder or Ladder(nodes)).lineage(leaves)
    segments = nodes.select(F.col("node").alias("ancestor"), "ids", F.transform("ids", lambda _: F.col("process")).alias("a"))
    parts = up.join(leaves.select("node", F.coalesce("reward", F.lit(0.0)).alias("reward")), "node").join(segments.where("ids is not null"), "ancestor")
    packed = parts.groupBy("node").agg(F.first("reward").alias("reward"), F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ids", "a"))).alias("p"))
    joined = lambda c: F.slice(F.flatten(F.col(f"p.{c}")), 1, most)
    rows = packed.select("node", "reward", joined("ids").alias("ids"), joined("a").alias("advantages")).where(F.size("ids") > 0)
    return rows.withColumn("advantage", F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x) / F.size("advantages"))
