"""Hard-negative mining by a full score sort for every anchor.

Anchors are a stated query set; they meet all rows in blocks. A block of anchors of at most ``BLOCK_BYTES`` is
broadcast, and rows stay where they are read: a task takes its rows ``ROWS`` at a time, computes the integer scores of
the block's anchors, sorts every anchor's scores (ties by vec_id), and keeps what the limits let through, so that
memory holds one block, one tile of scores and a few rows an anchor. Sorted heads of the tasks are merged by a ranking.

Two passes a block: the first finds each anchor's positives, the second cuts the sorted scores of rows of other labels
at each positive's upper limit and reads on from there to the lower limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.tables import cut

#: Bytes of anchors that are broadcast at once.
BLOCK_BYTES = 1 << 24
#: Rows whose scores are sorted at once, and anchors in a tile of them.
ROWS, TILE = 4096, 64
#: Score of no row; real ones are held above it and below 2**63.
NONE = -(1 << 63)
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class Limits:
    """``positives`` of an anchor, ``negatives`` of a positive, whose scores are between ``lower`` and ``upper`` percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    lower: int = 30
    upper: int = 90


@dataclass(frozen=True)
class Block:
    """Anchors in order of dimension and label, with the tiles (dimension, label, from, to) of anchors that have both in common."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[np.ndarray]
    tiles: list[tuple[int, object, int, int]]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, floor(256 * x)) of rows (vec_id, label, embedding) of one dimension each, in order of vec_id."""
    sizes = np.asarray(batch.column(2).value_lengths())
    for size in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        x = np.asarray(part.column(2).flatten(), np.float64).reshape(part.num_rows, size)
        order = np.argsort(np.asarray(part.column(0)), kind="stable")
        yield np.asarray(part.column(0))[order], np.asarray(part.column(1))[order], np.floor(256 * x[order])


def _block(rows: pa.Table) -> Block:
    ids, labels, vectors, tiles, n = [], [], [], [], 0
    for batch in rows.combine_chunks().to_batches():
        for i, k, x in _vectors(batch):
            order = np.argsort(k, kind="stable")
            ids.append(i[order]), labels.append(k[order]), vectors.extend(x[order])
            edges = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1])).tolist() + [len(k)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                tiles += [(x.shape[1], k[order][a], n + c, n + min(c + TILE, b)) for c in range(a, b, TILE)]
            n += len(k)
    return Block(np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*labels, np.zeros(0, np.int64)]), vectors, tiles)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Anchors x rows of inner products: exact in doubles while they fit, else by whole numbers held within 64 bits."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if anchors.shape[1] * most(anchors) * most(rows) < _EXACT:
        return anchors @ rows.T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    out = np.dot(whole(anchors), whole(rows).T) if anchors.shape[1] else np.zeros((len(anchors), len(rows)), object)
    return np.clip(out, NONE + 1, (1 << 63) - 1)


def _tiles(block: Block, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile and each slice of rows of its dimension: the anchors from, to, their scores, which rows share the label, and the rows' ids."""
    for ids, labels, x in _vectors(batch):
        for i in range(0, len(ids), ROWS):
            for size, label, a, b in block.tiles:
                if size == x.shape[1]:
                    yield a, b, _scores(np.stack(block.vectors[a:b]), x[i : i + ROWS]), labels[i : i + ROWS] == label, ids[i : i + ROWS]


class _Best:
    """The first ``k`` (score, id) of every slot, by score from above, then by id; slots are of the shape that is given."""

    def __init__(self, shape: tuple[int, ...], k: int):
        self.score, self.id, self.k = np.full((*shape, k), NONE, np.int64), np.zeros((*shape, k), np.int64), k

    def add(self, slots, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[slots], score], axis=-1), np.concatenate([self.id[slots], ids], axis=-1)
        # ~score turns the order of 64-bit integers round without overflow.
        order = np.lexsort((ids, ~score), axis=-1)[..., : self.k]
        self.score[slots], self.id[slots] = np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


def _positives(block, k: int):
    """Rows to (a, id, score): of each anchor, the first ``k`` rows of its label in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = _Best((len(anchors.ids),), k)
        for batch in batches:
            for a, b, score, same, ids in _tiles(anchors, batch):
                score, ids = score[:, same], ids[same]
                # An anchor's own rows go behind all others.
                own = ids == anchors.ids[a:b, None]
                score[own] = -np.inf
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                own = np.take_along_axis(own, order, 1)
                mine = np.where(own, NONE, np.where(own, 0, np.take_along_axis(score, order, 1)).astype(np.int64))
                best.add(slice(a, b), mine, ids[order])
        a, p = np.nonzero(best.score != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best.id[a, p]), pa.array(best.score[a, p])], names=["a", "id", "score"])

    return run


def _negatives(block, positive, limits: Limits):
    """Rows to (a, p, id, score): of each positive, the first rows of other labels within its limits in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (many, wanted) = block.value, positive.value
        best = _Best(wanted.shape, limits.negatives)
        for batch in batches:
            for a, b, score, same, ids in _tiles(anchors, batch):
                score, ids = score[:, ~same], ids[~same]
                order = np.argsort(-score, axis=1, kind="stable")
                score = np.take_along_axis(score, order, 1)
                got = np.full((b - a, wanted.shape[1], limits.negatives), NONE, np.int64)
                named = np.zeros_like(got)
                for i in range(b - a):
                    falling = -score[i]
                    for p in range(many[a + i]):
                        # 100 * score <= upper * positive and lower * positive <= 100 * score, in whole numbers.
                        most, least = (limits.upper * int(wanted[a + i, p])) // 100, -((-limits.lower * int(wanted[a + i, p])) // 100)
                        begin = int(np.searchsorted(falling, -most, side="left"))
                        end = min(int(np.searchsorted(falling, -least, side="right")), begin + limits.negatives)
                        if begin < end:
                            got[i, p, : end - begin], named[i, p, : end - begin] = score[i, begin:end].astype(np.int64), ids[order[i, begin:end]]
                best.add(slice(a, b), got, named)
        a, p, j = np.nonzero(best.score != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(p), pa.array(best.id[a, p, j]), pa.array(best.score[a, p, j])], names=["a", "p", "id", "score"])

    return run


def _ranked(rows: DataFrame, most: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _mined(rows: DataFrame, anchors: pa.Table, limits: Limits) -> DataFrame:
    """What one block of anchors mines from all rows, as a table."""
    spark = rows.sparkSession
    block = _block(anchors)
    shared = spark.sparkContext.broadcast(block)
    # A block's positives are bounded as the block is: a few numbers an anchor.
    found = _ranked(rows.mapInArrow(_positives(shared, limits.positives), "a bigint, id bigint, score bigint"), limits.positives, "a").toArrow()
    a, p = np.asarray(found.column("a")), np.asarray(found.column("rank")).astype(np.int64) - 1
    ids, score = (np.zeros((len(block.ids), limits.positives), np.int64) for _ in range(2))
    ids[a, p], score[a, p] = np.asarray(found.column("id")), np.asarray(found.column("score"))
    wanted = spark.sparkContext.broadcast((np.bincount(a, minlength=len(block.ids)), score))
    mined = rows.mapInArrow(_negatives(shared, wanted, limits), "a bigint, p bigint, id bigint, score bigint")
    ranked = _ranked(mined, limits.negatives, "a", "p")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, (_, scores) = shared.value.ids, wanted.value
        positive = names.value
        for batch in batches:
            a, p = (np.asarray(batch.column(i)) for i in range(2))
            columns = [pa.array(anchor[a]), pa.array(positive[a, p]), batch.column("rank"), batch.column("id"), pa.array(scores[a, p]), batch.column("score")]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    names = spark.sparkContext.broadcast(ids)
    return cut(ranked.mapInArrow(named, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"), "mined")


def hard_negatives(vectors: DataFrame, is_anchor: Column, limits: Limits | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) mined from ``vectors(vec_id, embedding, label)``.

    Components count as floor(256 * x); a row's score is its integer inner product with the anchor, and rows rank by
    score (descending), then vec_id. An anchor's positives are its first rows of the same label and another vec_id, a
    positive's negatives the first rows of other labels with lower * positive <= 100 * score <= upper * positive.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; a vector meets those of its
    own dimension. Of anchors that repeat in all three columns one counts; other repeated rows count each, so a repeated
    positive gives its rows again. An anchor without positives, or a positive without negatives, gives no row, as does an
    empty table; other columns are ignored. Scores beyond 64 bits are held at the ends of their range.
    """
    limits = limits or Limits()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.where(held).where(finite).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), is_anchor.alias("anchor"))
    anchors = cut(rows.where("anchor").select("vec_id", "label", "embedding").distinct(), "anchors")
    rows = rows.select("vec_id", "label", "embedding")
    size = anchors.agg(F.coalesce(F.sum(8 * F.size("embedding") + 64), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    if not blocks:
        return _empty(vectors)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)))
    return reduce(DataFrame.unionAll, [_mined(rows, dealt.where(F.col("block") == b).drop("block").toArrow(), limits) for b in range(blocks)])


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
