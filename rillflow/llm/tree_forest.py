"""Embedding near-dedup by a random-projection tree forest.

Trees are fitted on a bounded sample (``sample_rows``): a node splits by the direction between two of its vectors, at
the median, and vectors within ``spill`` of the node's width (its standard deviation along that direction) of the
split go to both sides. Every vector is then sent down every tree. A fitted tree has at most ``2**MOST_LEVELS``
leaves, so the broadcast forest is bounded; larger inputs go on below a leaf by seeded directions through the leaf's
centre, which take no memory. ``trees_for`` says how many trees a depth takes: copies per vector grow with about the
fourth root of the input.

Equal vectors are one node with a weight. A leaf compares its members in double precision, block against block if it
is large, counts a pair only in the least leaf that both share (the forest tells which, for linked members only), and
returns a count and a local component for each member, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.components import components
from rillflow.operators.tables import cut

MOST_LEVELS, BLOCK = 11, 2048
NULL_ID = -(1 << 63)


@dataclass
class Tree:
    direction: np.ndarray  # nodes x dimensions
    threshold: np.ndarray
    overlap: np.ndarray  # of each node, on either side of the threshold
    child: np.ndarray  # nodes x 2: a node, or -1 - leaf
    centre: np.ndarray  # leaves x dimensions
    width: np.ndarray  # of each leaf, along any direction


def fit_tree(sample: np.ndarray, levels: int, spill: float, rng: np.random.Generator) -> Tree:
    directions, thresholds, overlaps, children, centres, widths = [], [], [], [], [], []
    dimensions = sample.shape[1]

    def grow(rows: np.ndarray, level: int) -> int:
        if level == levels or len(rows) < 2:
            centres.append(sample[rows].mean(0) if len(rows) else np.zeros(dimensions))
            widths.append(float(np.sqrt(sample[rows].var(0).mean())) if len(rows) else 0.0)
            return -len(centres)
        a, b = rng.choice(len(rows), 2, replace=False)
        way = sample[rows[a]] - sample[rows[b]]
        size = np.linalg.norm(way)
        way = way / size if size > 1e-9 else (w := rng.normal(size=dimensions)) / np.linalg.norm(w)
        at = sample[rows] @ way
        middle, overlap = float(np.median(at)), spill * float(at.std())
        me = len(directions)
        directions.append(way), thresholds.append(middle), overlaps.append(overlap), children.append([0, 0])
        children[me][0] = grow(rows[at < middle + overlap], level + 1)
        children[me][1] = grow(rows[at >= middle - overlap], level + 1)
        return me

    grow(np.arange(len(sample)), 0)
    return Tree(np.array(directions).reshape(-1, dimensions), np.array(thresholds), np.array(overlaps), np.array(children).reshape(-1, 2), np.array(centres), np.array(widths))


@dataclass
class Forest:
    trees: list[Tree]
    spill: float
    deeper: int  # levels below the fitted leaves
    seed: int

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches; leaves have one numbering over all trees."""
        rows_out, leaves_out, base = [], [], 0
        for t, tree in enumerate(self.trees):
            work = [(0 if len(tree.direction) else -1, np.arange(len(vectors)))]
            while work:
                node, rows = work.pop()
                if not len(rows):
                    continue
                if node >= 0:
                    at = vectors[rows] @ tree.direction[node]
                    work.append((int(tree.child[node, 0]), rows[at < tree.threshold[node] + tree.overlap[node]]))
                    work.append((int(tree.child[node, 1]), rows[at >= tree.threshold[node] - tree.overlap[node]]))
                    continue
                leaf = -1 - node
                parts, overlap = [(0, rows)], self.spill * tree.width[leaf]
                for level in range(self.deeper):
                    way = np.random.default_rng((self.seed, t, level)).normal(size=vectors.shape[1])
                    way /= np.linalg.norm(way)
                    middle = float(tree.centre[leaf] @ way)
                    split = []
                    for code, some in parts:
                        at = vectors[some] @ way
                        split += [(2 * code, some[at < middle + overlap]), (2 * code + 1, some[at >= middle - overlap])]
                    parts = [p for p in split if len(p[1])]
                for code, some in parts:
                    rows_out.append(some)
                    leaves_out.append(np.full(len(some), base + (leaf << self.deeper) + code, np.int64))
            base += len(tree.centre) << self.deeper
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def trees_for(levels: int, least: float, spill: float, recall: float) -> int:
    """Trees in which a pair of cosine ``least`` shares a leaf with probability ``recall``, if directions cut it evenly.

    Such a pair's distance along a direction is normal with a deviation of sqrt(2 - 2 * least) node widths; a split loses it
    if it is cut with more than the overlap on both sides.
    """
    gap, cut_at = math.sqrt(max(0.0, 2 - 2 * least)), 2 * spill
    k = cut_at / gap if gap else 9.0
    beyond = gap * 2 * (math.exp(-k * k / 2) / math.sqrt(2 * math.pi) - k * (1 - math.erf(k / math.sqrt(2))) / 2)
    meet = (1 - 0.399 * beyond) ** levels
    return max(3, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 3


def fit(sample: np.ndarray, rows: int, least: float, trees: int | None, leaf_rows: int, spill: float, recall: float, seed: int) -> Forest:
    wanted = max(0, math.ceil(math.log2(max(1, rows / leaf_rows))))
    levels = min(wanted, MOST_LEVELS)
    rng = np.random.default_rng(seed)
    if trees is None:
        trees = trees_for(wanted, least, spill, recall) if wanted else 1
    return Forest([fit_tree(sample, levels, spill, rng) for _ in range(trees)], spill, wanted - levels, seed)


def unit(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of lists as unit vectors in double precision, shorter ones padded with zeros."""
    out = np.zeros((len(column), dimensions))
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


_LINKS = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])


def _compare(forest, least: float, dimensions: int):
    """Rows (leaf, bi, bj, block, c, w, v) of two blocks of a leaf to (c, n, to) of the linked ones."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf, bi, bj = (k.as_py() for k in key)
        n = table.num_rows
        vectors = unit(table.column("v").combine_chunks(), dimensions)
        side = table.column("block").to_numpy() == bi
        links = vectors @ vectors.T >= least
        links &= np.triu(np.ones((n, n), bool), 1) if bi == bj else side[:, None] & ~side[None, :]
        u, v = np.nonzero(links)
        used = np.unique(np.concatenate([u, v]))
        if not len(used):
            return _LINKS.empty_table()
        # Pairs that share an earlier leaf are counted there.
        row, leaves = forest.value.leaves(vectors[used])
        row, leaves = row[leaves < leaf], leaves[leaves < leaf]
        names, place = np.unique(leaves, return_inverse=True)
        inside = np.zeros((n, max(1, len(names))), np.float32)
        inside[used[row], place] = 1
        fresh = np.einsum("ij,ij->i", inside[u], inside[v]) == 0 if len(u) < 20_000 else (inside @ inside.T)[u, v] == 0
        weight = table.column("w").to_numpy()
        count = np.bincount(u[fresh], weight[v[fresh]], n) + np.bincount(v[fresh], weight[u[fresh]], n)
        label = local_components(n, u, v)
        ids = table.column("c").to_numpy()
        return pa.table({"c": ids[used], "n": count[used].astype(np.int64), "to": ids[label[used]]}, _LINKS)

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.9, trees: int | None = None, leaf_rows: int = 512, spill: float = 0.1, recall: float = 0.97, sample_rows: int = 20_000, seed: int = 11,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Links join rows of cosine ``least`` or more. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Shorter vectors count as padded with zeros. Equal vectors, repeated rows too, link
    with each other. A null vec_id counts as the least id and comes back null, also as a component. An empty table
    gives none. The forest finds most, not all pairs: about ``recall`` of those of cosine ``least``, more of closer ones; the
    tests measure it. ``trees``: how many, if not as many as ``recall`` takes.
    """
    good = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(embedding).cast(kind).alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.col("v"))).withColumn("c", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    nodes = cut(rows.where("c is not null").groupBy("c").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")), "vectors")
    head = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    total, dimensions = head[0], head[1] or 1
    sample = nodes.sample(False, min(1.0, sample_rows / max(1, total)), seed).select("v").toArrow().column(0).combine_chunks() if total else None
    found = unit(sample, dimensions) if sample is not None and len(sample) else np.zeros((0, dimensions))
    forest = vectors.sparkSession.sparkContext.broadcast(fit(found, total, least, trees, leaf_rows, spill, recall, seed))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                row, leaf = forest.value.leaves(unit(part.column(2), dimensions))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *[x.take(pa.array(row)) for x in part.columns]], names=["leaf", "c", "w", "v"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                leaf, n = np.unique(forest.value.leaves(unit(batch.column(0).slice(i, 8192), dimensions))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "rows"])

    sizes = nodes.select("v").mapInArrow(tally, "leaf bigint, rows bigint").groupBy("leaf").agg(F.sum("rows").alias("rows")).where("rows > 1")
    placed = nodes.select("c", "w", "v").mapInArrow(descend, f"leaf bigint, c bigint, w bigint, v {kind}")
    placed = placed.join(sizes, "leaf").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(c, leaf), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("leaf", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "c", "w", "v")
    each = cut(placed.groupBy("leaf", "bi", "bj").applyInArrow(_compare(forest, least, dimensions), "c bigint, n bigint, to bigint"), "links")
    counts = each.groupBy("c").agg(F.sum("n").alias("n"))
    joined = components(each.select(F.col("c").alias("u"), F.col("to").alias("v")))
    parts = nodes.select("c", "id", "w").join(joined.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    names = parts.groupBy("component").agg(F.min("id").alias("least"))
    known = parts.join(names, "component").join(counts, "c", "left").select("c", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = rows.select("id", "c").join(known, "c", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "id").alias("component"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("id").alias("vec_id"), "n_links", null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
