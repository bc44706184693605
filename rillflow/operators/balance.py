"""Token-balanced partitioning. Only lengths are needed; a batch's lengths fit one task by the batch's own definition."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_differencing(lengths: list[int], parts: int, equal_size: bool = False) -> list[int]:
    """The part of each item by Karmarkar and Karp: the two sets of partial sums that spread most are merged,
    the largest sum of one with the least of the other. ``equal_size``: every part gets as many items."""
    if equal_size and len(lengths) % parts:
        raise ValueError("items don't divide into equal parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    groups = [order[i : i + parts] for i in range(0, len(order), parts)] if equal_size else [[i] for i in order]
    heap = []
    for k, group in enumerate(groups):
        sums = sorted((-lengths[i], (i,)) for i in group)
        heap.append((-_spread(sums, parts), k, sums))
    heapq.heapify(heap)
    count = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = _merged(a, b, parts)
        heapq.heappush(heap, (-_spread(merged, parts), count, merged))
        count += 1
    out = [0] * len(lengths)
    if heap:
        for part, (_, items) in enumerate(sorted(heap[0][2], key=lambda s: min(s[1]))):
            for i in items:
                out[i] = part
    return out


#: A set of partial sums: (sum, negative; items) of the parts that have items, sorted. The others have no place in memory.
Sums = list[tuple[int, tuple[int, ...]]]
_NONE = (0, ())


def _spread(sums: Sums, parts: int) -> int:
    return -sums[0][0] + (sums[-1][0] if len(sums) == parts else 0)


def _merged(a: Sums, b: Sums, parts: int) -> Sums:
    """The largest of ``a`` with the least of ``b`` and so on. Parts without items stand behind all others that aren't 0. The longer list is changed, where the other falls on it."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    free, gap = parts - len(long), bisect_left(long, _NONE)
    own_free, own_gap = parts - len(short), bisect_left(short, _NONE)
    used, made = [], []
    for j, (n, items) in enumerate(short):
        at = parts - 1 - (j if j < own_gap else j + own_free)
        if gap <= at < gap + free:
            made.append((n, items))
        else:
            at -= free if at >= gap else 0
            used.append(at)
            m, others = long[at]
            made.append((m + n, others + items if long is a else items + others))
    if 16 * len(short) > len(long):
        gone = set(used)
        return sorted([x for i, x in enumerate(long) if i not in gone] + made)
    for at in sorted(used, reverse=True):
        del long[at]
    for x in made:
        insort(long, x)
    return long


def greedy(lengths: list[int], parts: int, equal_size: bool = False) -> list[int]:
    """Each item, in order, to the lightest part; ``equal_size`` adds a bias that makes counts come first."""
    if equal_size and len(lengths) % parts:
        raise ValueError("items don't divide into equal parts")
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, p) for p in range(parts)]
    out = []
    for n in lengths:
        total, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (total + n + bias, p))
    return out


METHODS = {"largest_differencing": largest_differencing, "greedy": greedy}


def assign(rows: DataFrame, batch: str, item: str, length: str, parts: int, method: str = "largest_differencing", equal_size: bool = False) -> DataFrame:
    """(batch, item, length, part): every batch is balanced on its own."""
    solve = METHODS[method]
    kinds = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(item)
        return g.assign(part=solve(g[length].tolist(), parts, equal_size))

    return rows.select(batch, item, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {item} {kinds[item]}, {length} {kinds[length]}, part int")


def micro_batches(rows: DataFrame, batch: str, length: str, most_tokens: int, least: int = 1, divisor: int = 1) -> DataFrame:
    """(batch, bins): min(rows, ceil(tokens / most_tokens)), at least ``least``, the largest of all batches, rounded up to ``divisor``."""
    each = rows.groupBy(batch).agg(F.greatest(F.lit(least), F.least(F.count(F.lit(1)), F.ceil(F.sum(length) / most_tokens))).alias("bins"))
    top = each.agg(F.max("bins").alias("most"))
    return each.join(F.broadcast(top)).select(batch, (F.ceil(F.col("most") / divisor) * divisor).cast("int").alias("bins"))


def imbalance(assigned: DataFrame, batch: str, length: str) -> DataFrame:
    """(batch, least, most, spread, mean) of the parts' sums."""
    sums = assigned.groupBy(batch, "part").agg(F.sum(length).alias("n"))
    return sums.groupBy(batch).agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("spread"), F.avg("n").alias("mean"))


def micro_batch_rows(rows: DataFrame, batch: str, item: str, length: str, most_tokens: int, least: int = 1, divisor: int = 1) -> DataFrame:
    """(batch, item, length, part): every batch in as many micro-batches as ``micro_batches`` says, of about equal tokens."""
    bins = micro_batches(rows, batch, length, most_tokens, least, divisor).agg(F.max("bins").alias("bins")).first().bins
    return assign(rows, batch, item, length, bins or 1)


def reordered(assigned: DataFrame, batch: str, item: str) -> DataFrame:
    """(batch, item, place): rows of a batch in the order of their parts, items ascending within one."""
    return assigned.select(batch, item, (F.row_number().over(Window.partitionBy(batch).orderBy("part", item)) - 1).alias("place"))
