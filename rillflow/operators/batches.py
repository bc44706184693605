"""Batch algebra over rows with a ``row_id``: 0, 1, 2 … in the batch's order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators.tables import cut


def number(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``row_id`` from a total order, without one task for all rows: ranges are sorted apart and offset by the counts before them.

    The ranges are written once: counts and rows come from the same table, however a later job would have drawn them."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    placed = cut(placed, "ranges")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_first")).orderBy("_p").collect()  # one row a partition
    at, starts = 0, []
    for c in counts:
        starts.append((c["_p"], at - c["_first"]))
        at += c["n"]
    offsets = spark.createDataFrame(starts, "_p int, _o long")
    known = F.coalesce("_o", F.raise_error(F.lit("a range without a count")).cast("long"))
    return placed.join(F.broadcast(offsets), "_p", "left").withColumn("row_id", F.col("_i") + known).drop("_p", "_i", "_o")


def running(rows: DataFrame, order: str, value: Column | Sequence[Column], total: Callable[[Column], Column], until: int = 0) -> DataFrame:
    """``_here`` and ``_before``: ``total`` of ``value`` up to each row (``until`` rows on) within its range of the numeric ``order``, and over all earlier
    ranges; null where there are no rows. Of several values, arrays. Ranges are those of a range partitioning, written once, so no task sorts all rows and the
    plan holds no bounds; one row a range is joined back. Rows without an order are a range of their own, before all others."""
    at = F.col(order).cast("double")
    several = not isinstance(value, Column)
    values = {f"_value{i}": v for i, v in enumerate(value if several else [value])}
    joined = lambda columns: F.array(*columns) if several else columns[0]
    placed = rows.withColumns(values).repartitionByRange(at).withColumn("_range", F.when(at.isNull(), -1).otherwise(F.spark_partition_id()))
    placed = cut(placed, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(*[total(F.col(v)).alias(v) for v in values]).select("_range", joined([total(F.col(v)).over(before) for v in values]).alias("_before"))  # one row a range
    here = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, until)
    return placed.withColumn("_here", joined([total(F.col(v)).over(here) for v in values])).join(F.broadcast(ranges), "_range").drop("_range", *values)


def project(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("row_id", *columns)


def pop(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The named columns as a batch of their own, and the rest."""
    return rows.select("row_id", *columns), rows.drop(*columns)


def rename(rows: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names, {len(new)} new ones")
    return rows.withColumnsRenamed(dict(zip(old, new, strict=True)))


def select_mask(rows: DataFrame, mask: Column) -> DataFrame:
    return renumber(rows.where(mask))


def renumber(rows: DataFrame) -> DataFrame:
    return number(rows.withColumnRenamed("row_id", "_old"), "_old").drop("_old")


def select_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows at ``places(pos, row_id)``; a row may come several times. ``row_id`` becomes ``pos``."""
    return rows.join(places, "row_id").drop("row_id").withColumnRenamed("pos", "row_id")


def take(rows: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, count: int | None = None) -> DataFrame:
    """A slice; negative bounds count from the end and need ``count``."""
    n = count if count is not None else (rows.count() if min(start or 0, stop or 0) < 0 or step < 0 else (1 << 62))
    a, b, s = slice(start, stop, step).indices(n)
    i = F.col("row_id")
    if s > 0:
        return rows.where((i >= a) & (i < b) & ((i - a) % s == 0)).withColumn("row_id", F.floor((i - a) / s))
    return rows.where((i <= a) & (i > b) & ((a - i) % -s == 0)).withColumn("row_id", F.floor((a - i) / -s))


def item(rows: DataFrame, key, count: int | None = None) -> DataFrame:
    """What ``batch[key]`` is: the row of an int, a slice, the rows of a list (in its order, negative ones from the end), or those of a mask, a column or a list of truth values; numbered afresh."""
    if isinstance(key, Column):
        return select_mask(rows, key)
    if isinstance(key, slice):
        return take(rows, key.start, key.stop, key.step or 1, count)
    places = [key] if isinstance(key, int) and not isinstance(key, bool) else list(key)
    if places and all(isinstance(p, bool) for p in places):
        places = [i for i, p in enumerate(places) if p]
    n = rows.count() if count is None else count
    if any(not -n <= p < n for p in places):
        raise IndexError(f"{n} rows: {key!r}")
    listed = rows.sparkSession.createDataFrame([(i, p % n) for i, p in enumerate(places)], "pos long, row_id long")
    return select_rows(rows, F.broadcast(listed) if len(places) < 100_000 else listed)


def reorder(rows: DataFrame, permutation: DataFrame) -> DataFrame:
    return select_rows(rows, permutation)


def reverse_index(permutation: DataFrame) -> DataFrame:
    """The inverse of ``permutation(pos, row_id)``."""
    return permutation.select(F.col("row_id").alias("pos"), F.col("pos").alias("row_id"))


def repeat(rows: DataFrame, times: int, interleave: bool = True, count: int | None = None) -> DataFrame:
    """Every row ``times`` times: AABB, or ABAB (which needs the number of rows)."""
    copies = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else rows.limit(0).withColumn("_k", F.lit(0))
    if interleave:
        return copies.withColumn("row_id", F.col("row_id") * times + F.col("_k")).drop("_k")
    n = rows.count() if count is None else count
    return copies.withColumn("row_id", F.col("row_id") + F.col("_k") * n).drop("_k")


def repeat_each(rows: DataFrame, times: Column) -> DataFrame:
    """Every row as often as its own count says (0: not at all), numbered afresh."""
    copies = rows.withColumn("_k", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))))
    return number(copies.withColumnRenamed("row_id", "_old"), "_old", "_k").drop("_old", "_k")


def fold(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """Runs of ``size`` rows as one row of arrays."""
    packed = rows.groupBy(F.floor(F.col("row_id") / size).alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("row_id", *columns))).alias("_s"))
    return packed.select("row_id", *[F.col(f"_s.{c}").alias(c) for c in columns])


def unfold(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    each = rows.select(F.col("row_id").alias("_b"), F.posexplode(F.arrays_zip(*columns)).alias("_i", "_x"))
    return each.select((F.col("_b") * size + F.col("_i")).alias("row_id"), *[F.col(f"_x.{c}").alias(c) for c in columns])


def chunk(rows: DataFrame, parts: int, count: int, padded: bool = False) -> DataFrame:
    """``chunk`` number of each row: equal parts (an error if they can't be), or with padding on parts of ceil(n / parts)."""
    if not padded and count % parts:
        raise ValueError(f"{count} rows don't make {parts} equal parts")
    return rows.withColumn("chunk", F.floor(F.col("row_id") / -(-count // parts)).cast("int"))


def balanced_slice(rows: DataFrame, parts: int, count: int) -> DataFrame:
    """``chunk``: near-equal parts, longer ones first."""
    base, extra = divmod(count, parts)
    edge = extra * (base + 1)
    i = F.col("row_id")
    return rows.withColumn("chunk", F.when(i < edge, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - edge) / max(base, 1))).cast("int"))


def pad_to_divisor(rows: DataFrame, divisor: int, count: int) -> tuple[DataFrame, int]:
    """Rows from the head, over and over, until their number divides; and how many were added."""
    more = -count % divisor
    if not more or not count:
        return rows, 0
    laps = F.explode(F.sequence(F.lit(1), F.lit(-(-more // count))))
    extra = rows.withColumn("_k", laps).withColumn("row_id", F.col("row_id") + F.col("_k") * count).drop("_k").where(F.col("row_id") < count + more)
    return rows.unionByName(extra), more


def unpad(rows: DataFrame, added: int, count: int) -> DataFrame:
    return rows.where(F.col("row_id") < count - added)


def pad_with(rows: DataFrame, size: int, count: int, candidate: str = "first") -> DataFrame:
    """``size`` more copies of the first or last row."""
    at = 0 if candidate == "first" else count - 1
    extra = rows.where(F.col("row_id") == at).withColumn("row_id", F.explode(F.sequence(F.lit(count).cast("long"), F.lit(count + size - 1).cast("long"))))
    return rows.unionByName(extra) if size else rows


def mini_batches(rows: DataFrame, size: int, epochs: int, seed: int) -> DataFrame:
    """(epoch, batch) of each row: every epoch its own order, by hash."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", "row_id")))
    placed = number(each.withColumnRenamed("row_id", "_row"), "epoch", "_h", "_row")
    first = placed.groupBy("epoch").agg(F.min("row_id").alias("_first"))  # one row an epoch
    out = placed.join(F.broadcast(first), "epoch").withColumn("batch", F.floor((F.col("row_id") - F.col("_first")) / size).cast("int"))
    return out.drop("_h", "_first", "row_id").withColumnRenamed("_row", "row_id")


def union_columns(a: DataFrame, b: DataFrame, nan_equal: bool = True) -> DataFrame:
    """Row by row; shared columns must be equal, or it is an error. NaN equals NaN only with ``nan_equal``."""
    shared = [c for c in b.columns if c in a.columns and c != "row_id"]
    right = b.select("row_id", *[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in b.columns if c != "row_id"])
    out = a.join(right, "row_id")
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        if not nan_equal and dict(a.dtypes)[c] in ("double", "float"):
            same = same & ~F.isnan(c)
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(a.dtypes)[c])))
    return out.drop(*[f"_{c}" for c in shared])


def mismatches(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows whose shared column differs."""
    return a.select("row_id", F.col(column).alias("a")).join(b.select("row_id", F.col(column).alias("b")), "row_id").where(~F.col("a").eqNullSafe(F.col("b")))


def concat(parts: Sequence[DataFrame], counts: Sequence[int]) -> DataFrame:
    """Rows of all parts one after the other; columns must match."""
    out, at = None, 0
    for part, n in zip(parts, counts, strict=True):
        if out is not None and set(part.columns) != set(out.columns):
            raise ValueError("parts have different columns")
        moved = part.withColumn("row_id", F.col("row_id") + at)
        out, at = (moved if out is None else out.unionByName(moved)), at + n
    if out is None:
        raise ValueError("nothing to concatenate")
    return out


def union_filled(parts: Sequence[DataFrame], fills: dict[str, object]) -> DataFrame:
    """Union with typed fills for the columns that a part lacks."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def interleaved(parts: Sequence[DataFrame], counts: Sequence[int], workers: int, fills: dict[str, object]) -> DataFrame:
    """Parts numbered so that consecutive runs of rows go to ``workers`` (column ``worker``), each with its share of every part, parts in order; absent columns are filled.

    Worker i gets the rows from floor(i n / W) of a part of n rows, so shares differ by one row at most. A row's place is
    arithmetic on its number in its part: nothing is sorted or gathered.
    """
    begin = lambda i, n: F.floor(i * n / workers)
    out = []
    for at, (part, n) in enumerate(zip(parts, counts, strict=True)):
        if n < 1:
            continue
        worker = F.floor((F.col("row_id") * workers + workers + n - 1) / n) - 1
        before = sum((begin(F.col("worker"), m) for m in counts), F.lit(0)) + sum((begin(F.col("worker") + 1, m) - begin(F.col("worker"), m) for m in counts[:at]), F.lit(0))
        moved = part.withColumn("worker", worker.cast("long"))
        out.append(moved.withColumn("row_id", (before + F.col("row_id") - begin(F.col("worker"), n)).cast("long")))
    if not out:
        raise ValueError("nothing to interleave")
    return union_filled(out, fills)


def zipped(columns: dict[str, DataFrame]) -> DataFrame:
    """A batch from columns that are tables of their own, ``(row_id, value)`` each and numbered from 0; columns of different lengths are an error."""
    sizes = {name: c.count() for name, c in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of different lengths: {sizes}")
    out = None
    for name, c in columns.items():
        one = c.select("row_id", F.col("value").alias(name))
        out = one if out is None else out.join(one, "row_id")
    if out is None:
        raise ValueError("a batch without columns")
    return out


_FLOATS = ("float", "double")


def digests(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, rows, total, nans) of columns over ``row_id``: an order-free digest, two 64-bit hashes of each (row_id, value) added up, and the NaNs in it.

    Batches with equal digests are equal but for a chance of 2**-64, so two of any size are compared without a join. Nulls, NaNs and both zeros count as values of their own."""
    kinds = dict(rows.dtypes)
    plain = {c: F.col(c) + F.lit(0.0).cast(kinds[c]) if kinds[c] in _FLOATS else F.col(c) for c in columns}
    both = lambda c: [F.sum(F.xxhash64("row_id", F.isnull(c), c, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    nans = lambda c: F.count_if(F.isnan(c)) if kinds[c] in _FLOATS else F.count_if(F.exists(c, lambda x: F.isnan(x))) if kinds[c] in ("array<float>", "array<double>") else F.lit(0).cast("long")
    each = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *[F.coalesce(t, F.lit(0)).cast("string") for t in both(plain[c])]).alias("total"), nans(c).alias("nans")) for c in columns]
    return rows.agg(F.array(*each).alias("d")).select(F.explode("d").alias("d")).select("d.*")


def equal_columns(a: DataFrame, b: DataFrame, *columns: str, nan_equal: bool = True) -> DataFrame:
    """(column, equal) of columns that both batches have. Without ``nan_equal`` a NaN equals nothing, itself included."""
    other = digests(b, *columns).select("column", F.struct("rows", "total").alias("o"))
    kept = digests(a, *columns).join(F.broadcast(other), "column")
    return kept.select("column", ((F.struct("rows", "total") == F.col("o")) & (F.lit(nan_equal) | (F.col("nans") == 0))).alias("equal"))


def united(a: DataFrame, b: DataFrame, nan_equal: bool = True) -> DataFrame:
    """``a`` with the columns of ``b`` that it lacks; shared ones must be equal, or it is an error before anything is joined."""
    shared = [c for c in b.columns if c in a.columns and c != "row_id"]
    if shared and (other := [r.column for r in equal_columns(a, b, *shared, nan_equal=nan_equal).where("not equal").collect()]):
        raise ValueError(f"columns differ: {', '.join(sorted(other))}")
    return a.join(b.drop(*shared), "row_id")


def consistency(rows: DataFrame, required: dict[str, str]) -> DataFrame:
    """(check, ok): that required columns are there with their types, that ``row_id`` has no nulls, no repeats and no gaps, and that arrays of a column are equally long."""
    kinds = dict(rows.dtypes)
    known = [(f"{c} is {t}", kinds.get(c) == t) for c, t in required.items()]
    arrays = [c for c, t in rows.dtypes if t.startswith("array")]
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count("row_id").alias("named"), F.min("row_id").alias("least"), F.max("row_id").alias("most"), *[(F.count_distinct(F.size(c)) <= 1).alias(f"_{i}") for i, c in enumerate(arrays)])
    repeats = rows.where("row_id is not null").groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("times"), F.count(F.lit(1)).alias("ids"))
    one = counts.join(F.broadcast(repeats))
    checks = [(F.lit(k), F.lit(v)) for k, v in known] + [(F.lit("row_id has no nulls"), F.col("n") == F.col("named")), (F.lit("row_id has no repeats"), F.col("times") == 1)]
    checks += [(F.lit("row_id has no gaps"), (F.col("ids") == 0) | ((F.col("least") == 0) & (F.col("most") == F.col("ids") - 1)))] + [(F.lit(f"{c} is equally long"), F.col(f"_{i}")) for i, c in enumerate(arrays)]
    return one.select(F.explode(F.array(*[F.struct(k.alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks])).alias("c")).select("c.*")


def check_consistency(rows: DataFrame, required: dict[str, str]) -> list[str]:
    """What is wrong with a batch's schema."""
    have = dict(rows.dtypes)
    return [f"{c}: missing" if c not in have else f"{c}: {have[c]}, not {t}" for c, t in required.items() if have.get(c) != t]


def equal_length_trim(rows: DataFrame, workers: int, count: int, seed: int) -> DataFrame:
    """A permutation by hash without the last ``count % workers`` rows."""
    shuffled = number(rows.withColumnRenamed("row_id", "_old").withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "_old"))), "_h").drop("_h")
    return shuffled.where(F.col("row_id") < count - count % workers)


def from_columns(spark: SparkSession, columns: dict[str, Sequence[object]], schema: str) -> DataFrame:
    """A batch from lists of equal length; another length is an error."""
    sizes = {k: len(v) for k, v in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of different lengths: {sizes}")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [(i, *row) for i, row in enumerate(zip(*(columns[n] for n in names), strict=True))]
    return spark.createDataFrame(rows, f"row_id long, {schema}")


def union_maps(a: Column, b: Column) -> Column:
    """Both maps as one; a key with two values is an error."""
    clash = F.filter(F.map_keys(a), lambda k: F.coalesce(F.map_contains_key(b, k) & ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)), F.lit(False)))
    more = F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))
    return F.when(F.size(clash) > 0, F.raise_error(F.concat(F.lit("two values for "), F.array_join(clash.cast("array<string>"), ", "))).cast("map<string,string>")).otherwise(F.map_concat(a, more))


def appended(rows: DataFrame, more: DataFrame, keep: Column) -> DataFrame:
    """``rows`` and those of ``more`` that ``keep`` holds for, numbered on."""
    base = rows.agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).alias("_n"))
    new = number(more.where(keep).drop("row_id"), *[c for c in more.columns if c != "row_id"])
    return rows.unionByName(new.join(F.broadcast(base)).withColumn("row_id", F.col("row_id") + F.col("_n")).drop("_n"))


def sampler_order(rows: DataFrame, kind: str, seed: int = 0, difficulty: str | None = None) -> DataFrame:
    """``place``: the order in which a sampler visits rows: ``sequential``, ``random`` (by a seeded hash) or ``curriculum`` (least ``difficulty`` first)."""
    keys = {"sequential": [F.col("row_id")], "random": [F.md5(F.concat_ws(":", F.lit(str(seed)), "row_id")), F.col("row_id")], "curriculum": [F.col(difficulty or "row_id"), F.col("row_id")]}
    if kind not in keys:
        raise ValueError(f"unknown sampler {kind!r}")
    keyed = rows.select("row_id", *[k.alias(f"_k{i}") for i, k in enumerate(keys[kind])]).withColumnRenamed("row_id", "_row")
    placed = number(keyed, *[f"_k{i}" for i in range(len(keys[kind]))])
    return rows.join(placed.select(F.col("_row").alias("row_id"), F.col("row_id").alias("place")), "row_id")
