"""Queries: batch algebra, balancing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import balance, batches, sampling
from rillflow.plans.bindings import R, rollouts
from rillflow.plans.catalog import query, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.number(_orders(spark, sf_dir), "key")


O = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey AS key, o_totalprice AS price, o_orderpriority AS priority FROM orders), n AS (SELECT count(*) AS n FROM o)"  # noqa: E741


@query("batch_number", f"WITH {O} SELECT row_id, key FROM o")
def batch_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.project(_rows(spark, sf_dir), "key")


@query("batch_pop_rename", f"WITH {O} SELECT row_id, price AS cost FROM o")
def batch_pop_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.rename(batches.pop(_rows(spark, sf_dir), "price")[0], ["price"], ["cost"])


@query("batch_select_mask", f"WITH {O} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, key FROM o WHERE priority = '1-URGENT'")
def batch_select_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.select_mask(_rows(spark, sf_dir), F.col("priority") == "1-URGENT").select("row_id", "key")


@query("batch_select_rows", f"WITH {O}, p AS (SELECT unnest(range(100)) AS pos) SELECT pos AS row_id, key FROM p JOIN o ON o.row_id = (pos * 37) % 50")
def batch_select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.range(100).selectExpr("id as pos", "(id * 37) % 50 as row_id")
    return batches.select_rows(_rows(spark, sf_dir), places).select("row_id", "key")


@query("batch_slice", f"WITH {O} SELECT (row_id - 10) // 3 AS row_id, key FROM o, n WHERE row_id >= 10 AND row_id < n - 5 AND (row_id - 10) % 3 = 0")
def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.take(_rows(spark, sf_dir), 10, -5, 3).select("row_id", "key")


@query("batch_reorder", f"WITH {O} SELECT n - 1 - row_id AS row_id, key FROM o, n")
def batch_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    n = rows.count()
    turned = rows.select((F.lit(n - 1) - F.col("row_id")).alias("pos"), "row_id")
    return batches.reorder(batches.reorder(batches.reorder(rows, turned), batches.reverse_index(turned)), turned).select("row_id", "key")


@query("batch_repeat", f"""WITH {O}, k AS (SELECT unnest(range(3)) AS k) SELECT 'AABB' AS kind, row_id * 3 + k AS row_id, key FROM o, k
  UNION ALL SELECT 'ABAB', row_id + k * n, key FROM o, k, n""")  # fmt: skip
def batch_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    a, b = batches.repeat(rows, 3), batches.repeat(rows, 3, interleave=False)
    return a.select(F.lit("AABB").alias("kind"), "row_id", "key").unionAll(b.select(F.lit("ABAB").alias("kind"), "row_id", "key"))


@query("batch_repeat_each", f"WITH {O}, c AS (SELECT *, unnest(range(1, key % 3 + 1)) AS k FROM o) SELECT row_number() OVER (ORDER BY row_id, k) - 1 AS row_id, key FROM c")
def batch_repeat_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.repeat_each(_rows(spark, sf_dir), F.col("key") % 3).select("row_id", "key")


@query("batch_fold", f"WITH {O} SELECT row_id // 4 AS row_id, string_agg(key::VARCHAR, ',' ORDER BY row_id) AS keys FROM o GROUP BY 1")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.fold(_rows(spark, sf_dir), 4, "key").select("row_id", F.array_join(F.col("key").cast("array<string>"), ",").alias("keys"))


@query("batch_unfold", f"WITH {O} SELECT row_id, key FROM o")
def batch_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.unfold(batches.fold(_rows(spark, sf_dir), 4, "key"), 4, "key")


@query("batch_unfold_chunks", "SELECT vec_id * 4 + k AS row_id, label, round(list_sum(list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda x: x::DOUBLE)), 5) AS total FROM embeddings, (SELECT unnest(range(4)) AS k)")
def batch_unfold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.functions import tokens as tk

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(tk.unfold(F.col("embedding").cast("array<double>"), 4)).alias("k", "x"))
    return rows.select((F.col("vec_id") * 4 + F.col("k")).alias("row_id"), "label", F.round(tk.total("x"), 5).alias("total"))


@query("batch_chunk", f"WITH {O} SELECT row_id, (row_id // ((n + 6) // 7))::INT AS padded, CASE WHEN row_id < (n % 7) * (n // 7 + 1) THEN row_id // (n // 7 + 1) ELSE n % 7 + (row_id - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS balanced FROM o, n")
def batch_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    n = rows.count()
    a = batches.chunk(rows, 7, n, padded=True).select("row_id", F.col("chunk").alias("padded"))
    return a.join(batches.balanced_slice(rows, 7, n).select("row_id", F.col("chunk").alias("balanced")), "row_id")


@query("batch_pad_unpad", f"""WITH {O}, m AS (SELECT n, (64 - n % 64) % 64 AS more FROM n) SELECT row_id, key FROM o UNION ALL SELECT row_id + n, key FROM o, m WHERE row_id < more""")
def batch_pad_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batches.pad_to_divisor(rows, 64, rows.count())[0].select("row_id", "key")


@query("batch_pad_with_last", f"WITH {O} SELECT row_id, key FROM o UNION ALL SELECT n + k, key FROM o, n, (SELECT unnest(range(5)) AS k) WHERE row_id = n - 1")
def batch_pad_with_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batches.pad_with(rows, 5, rows.count(), "last").select("row_id", "key")


@query("batch_mini_batches", f"WITH {O}, e AS (SELECT *, unnest(range(2))::INT AS epoch FROM o) SELECT epoch, row_id, ((row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || row_id)) - 1) // 256)::INT AS batch FROM e")
def batch_mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.mini_batches(_rows(spark, sf_dir), 256, 2, 7).select("epoch", "row_id", "batch")


@query("batch_union", f"WITH {O} SELECT row_id, key, price, priority FROM o")
def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batches.union_columns(rows.select("row_id", "key", "price"), rows.select("row_id", "price", "priority"))


@query("batch_mismatches", f"WITH {O} SELECT row_id, priority AS a, CASE WHEN key % 100 = 0 THEN NULL ELSE priority END AS b FROM o WHERE key % 100 = 0")
def batch_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batches.mismatches(rows, rows.withColumn("priority", F.when(F.col("key") % 100 != 0, F.col("priority"))), "priority")


@query("batch_concat", f"WITH {O} SELECT row_id, key FROM o UNION ALL SELECT row_id + n, key FROM o, n")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("row_id", "key")
    n = rows.count()
    return batches.concat([rows, rows], [n, n])


@query("batch_union_filled", f"WITH {O} SELECT key, 0 AS source, price FROM o WHERE key % 2 = 0 UNION ALL SELECT key, 2, -1.0::DOUBLE FROM o WHERE key % 2 = 1")
def batch_union_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    main = rows.where("key % 2 = 0").select("key", F.lit(0).alias("source"), "price")
    teacher = rows.where("key % 2 = 1").select("key", F.lit(2).alias("source"))
    return batches.union_filled([main, teacher], {"price": -1.0})


@query("batch_trim", f"WITH {O}, s AS (SELECT key, row_number() OVER (ORDER BY md5('3:' || row_id)) - 1 AS row_id FROM o) SELECT row_id, key FROM s, n WHERE row_id < n - n % 7")
def batch_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batches.equal_length_trim(rows, 7, rows.count(), 3).select("row_id", "key")


@query("batch_duplicates", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def batch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("balance_differencing")
def balance_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 16 as batch", "p_partkey as item", "cast(p_size as bigint) as length")
    return balance.assign(rows, "batch", "item", "length", 4)


@query("balance_greedy_imbalance")
def balance_greedy_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 16 as batch", "p_partkey as item", "cast(p_size as bigint) as length")
    return balance.imbalance(balance.assign(rows, "batch", "item", "length", 4, "greedy"), "batch", "length")


@query("balance_micro_batches", """WITH e AS (SELECT p_partkey % 16 AS batch, greatest(1, least(count(*), ceil(sum(p_size) / 300.0))) AS bins FROM part GROUP BY 1)
  SELECT batch, (ceil((SELECT max(bins) FROM e) / 4.0) * 4)::INT AS bins FROM e""")  # fmt: skip
def balance_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 16 as batch", "cast(p_size as bigint) as length")
    return balance.micro_batches(rows, "batch", "length", 300, divisor=4)


_U = "(('0x' || substr(md5('{}:' || {}), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"


@query("sample_weighted", f"SELECT p_partkey AS key FROM part ORDER BY CASE WHEN p_size > 10 THEN ln({_U.format(5, 'p_partkey')}) / (p_size - 10) ELSE '-inf'::DOUBLE END DESC, p_partkey LIMIT 100")
def sample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as key", "cast(p_size - 10 as double) as w")
    return sampling.weighted_without_replacement(rows, "w", 100, 5, "key").select("key")


@query("sample_success_weights", f"""WITH {R}, g AS (SELECT uid, count(*) AS n, count(*) FILTER (reward > 25) AS k FROM r GROUP BY uid)
  SELECT uid, round(CASE WHEN k = 0 THEN 0.2::DOUBLE WHEN k = n THEN 0.01::DOUBLE ELSE 4 * (k / n) * (1 - k / n) END, 6) AS weight FROM g""")  # fmt: skip
def sample_success_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") > 25).alias("k"))
    return rows.select("uid", F.round(sampling.success_weight(F.col("k"), F.col("n")), 6).alias("weight"))


@query("sample_capped", "SELECT o_custkey AS cust, o_orderkey AS key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def sample_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as cust", "o_orderkey as key", "o_totalprice as price")
    return sampling.capped(rows, "cust", 2, F.desc("price"), "key").select("cust", "key")


@query("sample_round_robin", f"""WITH u AS (SELECT o_custkey AS cust, o_orderkey AS key, {_U.format(9, 'o_orderkey')} AS u FROM orders),
  l AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY u, key) AS lap FROM u) SELECT cust, key, lap::INT AS lap FROM l ORDER BY lap, u, key LIMIT 2000""")  # fmt: skip
def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as cust", "o_orderkey as key")
    return sampling.round_robin(rows, "cust", 2000, 9, "key").select("cust", "key", "lap")


@query("sample_priority", """WITH l AS (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS newest, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS lap FROM events)
  SELECT user_id, event_id, newest, lap::INT AS lap FROM l ORDER BY lap, newest DESC, user_id LIMIT 400""")  # fmt: skip
def sample_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    return sampling.priority_laps(rows, "user_id", "event_id", 400).select("user_id", "event_id", "newest", "lap")


@query("sample_resample", f"""WITH p AS (SELECT p_partkey AS key, p_size AS w, sum(p_size) OVER (ORDER BY p_partkey) AS hi FROM part),
  d AS (SELECT draw, {_U.format(21, 'draw')} * (SELECT sum(p_size) FROM part) AS x FROM (SELECT unnest(range(500)) AS draw))
  SELECT draw, key FROM d JOIN p ON x >= hi - w AND x < hi""")  # fmt: skip
def sample_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as key", "cast(p_size as double) as w")
    return sampling.resample(rows, "w", 500, 21, "key").select("draw", "key")


@query("sample_reweight", """SELECT p_partkey AS key, round(power(abs(p_size - 25.0::DOUBLE), 2), 4) AS pow, CASE WHEN p_size = (SELECT max(p_size) FROM part) OR p_size = (SELECT min(p_size) FROM part) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS extreme,
  CASE WHEN p_size = (SELECT max(p_size) FROM part) THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS top FROM part""")  # fmt: skip
def sample_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") - 25.0).alias("s"), "p_size")
    out = sampling.reweight(sampling.reweight(sampling.reweight(rows, "s", "pow", 2.0, "pow"), "p_size", "max_min", name="extreme"), "p_size", "max_random", name="top")
    return out.select("key", F.round("pow", 4).alias("pow"), "extreme", "top")


@query("batch_item", f"""WITH {O}, i AS (SELECT 'int' AS kind, 0 AS row_id, key FROM o, n WHERE row_id = n - 3 UNION ALL SELECT 'slice', row_id - 5, key FROM o WHERE row_id >= 5 AND row_id < 9
  UNION ALL SELECT 'list', j.i, key FROM (VALUES (0, 4), (1, 2), (2, 2)) j(i, place) JOIN o ON o.row_id = j.place UNION ALL SELECT 'mask', row_number() OVER (ORDER BY row_id) - 1, key FROM o WHERE key % 5 = 0) SELECT kind, row_id::BIGINT AS row_id, key FROM i""")  # fmt: skip
def batch_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    keys = {"int": -3, "slice": slice(5, 9), "list": [4, 2, 2], "mask": F.col("key") % 5 == 0}
    parts = [batches.item(rows, k).select(F.lit(name).alias("kind"), F.col("row_id").cast("long").alias("row_id"), "key") for name, k in keys.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
