"""Queries: readers and sinks, graders of tables and reports, samplers, registries and metrics of further trainers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import grading as g
from rillflow.functions import tokens as tk
from rillflow.operators import advantages, batches, metrics, rewards, sampling, trees
from rillflow.operators.registry import ESTIMATORS, KL_CONTROLLERS, POLICY_LOSSES, REWARD_MANAGERS, Registry
from rillflow.operators.tables import shared_dir
from rillflow.plans.batch_queries import O, _rows
from rillflow.plans.bindings import R, T, rollouts, sequences, tokens
from rillflow.plans.catalog import query, table
from rillflow.plans.state_queries import N, _nodes
from rillflow.sources import datasets


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rillflow/{name}-{uuid.uuid4().hex}"


#: Answers by ``doc_id % 16``: (answer, truth), with ``N`` for the number ``doc_id + 1000``.
_TABLE = (
    ("N", "N"), ("N,000", "N000"), ("N pages", "Npages"), ("N", "N pages"), ("1 week", "7 days"), ("N.0", "N"), ("N.5", "N.50"), ("b, a", "A|B"), ("a,b", "a,c"), ("Café N!", "cafe  n"),
    ("The X.", "the x"), ("", ""), ("x", ""), ("1 year", "12 months"), ("N km/h", "N mph"), ("a|a, b", "b|a"),
)


def _table_sql(side: int) -> str:
    return "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN replace('{p[side]}', 'N', (doc_id + 1000)::VARCHAR)" for i, p in enumerate(_TABLE)) + " END"


def _spelling(c: str) -> str:
    number = f"TRY_CAST(replace({c}, ',', '') AS DOUBLE)"
    unit = r"^([\d,]+)\s*(days|years|pages|km/h|mph)$"
    items = rf"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({c}, '[|,]\s*'), lambda x: trim(x)), lambda x: x <> '')), '|')"
    return (
        rf"CASE WHEN {c} = '' THEN '' WHEN regexp_matches({c}, '{unit}') THEN replace(regexp_extract({c}, '{unit}', 1), ',', '') || ' ' || regexp_extract({c}, '{unit}', 2) WHEN regexp_matches({c}, '^[\d,]+$') THEN replace({c}, ',', '')"
        rf" WHEN {c} = '1 week' THEN '7 days' WHEN {c} = '2 weeks' THEN '14 days' WHEN {c} = '1 year' THEN '12 months' WHEN {number} IS NOT NULL THEN CASE WHEN {number} = floor({number}) THEN {number}::BIGINT::VARCHAR ELSE {number}::VARCHAR END"
        rf" WHEN contains({c}, '|') OR contains({c}, ',') THEN {items} ELSE trim(regexp_replace(regexp_replace(strip_accents({c}), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) END"
    )


@query("grade_table_answer", rf"""WITH p AS (SELECT doc_id, {_table_sql(0)} AS a, {_table_sql(1)} AS t FROM documents), l AS (SELECT doc_id, a, t, trim(lower(a)) AS la, trim(lower(t)) AS lt FROM p),
  s AS (SELECT doc_id, a, t, {_spelling('la')} AS x, {_spelling('lt')} AS y, list_sort(list_distinct(regexp_split_to_array(lower(a), '[|,]\s*'))) AS i, list_sort(list_distinct(regexp_split_to_array(lower(t), '[|,]\s*'))) AS j FROM l)
  SELECT doc_id, x AS spelling, (x = y OR (regexp_matches(x, '^\d+$') AND regexp_matches(y, '^\d+\s+[a-z/]+$') AND x = regexp_extract(y, '^(\d+)\s', 1)) OR (len(i) > 1 AND i = j)) AS correct FROM s""")  # fmt: skip
def grade_table_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("doc_id") % 16, (F.col("doc_id") + 1000).cast("string")
    pick = lambda side: F.coalesce(*[F.when(kind == i, F.replace(F.lit(p[side]), F.lit("N"), n)) for i, p in enumerate(_TABLE)])
    rows = table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("a"), pick(1).alias("t"))
    return rows.select("doc_id", g.table_answer(F.col("a")).alias("spelling"), g.table_match(F.col("a"), F.col("t")).alias("correct"))


@query("grade_strict_box", r"""WITH p AS (SELECT doc_id, n_chars::VARCHAR AS n, right(text || '\boxed{' || n_chars || '}' || repeat('.', (doc_id % 150)::INT), 100) AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, '\boxed{' || n || '}') THEN 1 ELSE -1 END::INT AS score FROM p""")  # fmt: skip
def grade_strict_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    t = F.concat("text", F.lit("\\boxed{"), n, F.lit("}"), F.repeat(F.lit("."), (F.col("doc_id") % 150).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", g.strict_box(t, n).alias("score"))


@query("grade_boxed_format", r"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || text || '</think> ' ELSE text || ' ' END || CASE WHEN doc_id % 2 = 0 THEN '\boxed{' || n_chars || '}' ELSE '\boxed{' || n_chars || '1}' END || ' ok' AS t, n_chars::VARCHAR AS n FROM documents)
  SELECT doc_id, round(0.9::DOUBLE * (contains(t, '\boxed{' || n || '}'))::INT + 0.1::DOUBLE * (regexp_full_match(t, '(?s)<think>.*</think>.*\\boxed\{.*\}.*'))::INT, 6) AS score FROM p""")  # fmt: skip
def grade_boxed_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> "))).otherwise(F.concat("text", F.lit(" ")))
    box = F.concat(F.lit("\\boxed{"), n, F.when(F.col("doc_id") % 2 == 0, "}").otherwise("1}"), F.lit(" ok"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(g.boxed_and_format(F.concat(head, box), n), 6).alias("score"))


def _soundness_reply(c: Column) -> Column:
    scores = F.concat(F.lit('{"faithfulness": '), (c % 5).cast("string"), F.lit(', "instruction_answering": 1.5, "analytical_depth": 0, "process_coherence": 4, "visualization": '), (c % 4).cast("string"), F.lit("}"))
    fenced = F.concat(F.lit("```json\n{}\n``` then ```JSON\n"), scores, F.lit("\n```"))
    return F.when(c % 3 == 0, scores).when(c % 3 == 1, fenced).otherwise(F.concat(F.lit("so ```"), scores, F.lit("```")))


@query("grade_soundness", "SELECT doc_id, (doc_id % 5)::DOUBLE AS faithfulness, round(((doc_id % 5) + 1.5 + 4 + doc_id % 4)::DOUBLE, 6) AS total FROM documents")
def grade_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", g.soundness(_soundness_reply(F.col("doc_id"))).alias("s"))
    return s.select("doc_id", "s.faithfulness", F.round(sum((F.col(f"s.{k}") for k in g.SOUNDNESS), F.lit(0.0)), 6).alias("total"))


@query("grade_number_unchecked", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS reward, 1::INT AS completed FROM documents""")
def grade_number_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    t = F.when(kind == 0, F.concat(F.lit("#### 1 #### "), n)).when(kind == 1, F.concat(F.lit("#### "), n)).otherwise("#### -1")
    s = g.number_score(t, n, check_repeats=False)
    return table(spark, sf_dir, "documents").select("doc_id", s.reward.alias("reward"), s.completed.alias("completed"))


@query("masked_mean_of_all", f"WITH {T} SELECT round(avg(r) FILTER (m <> 0), 6) AS mean, count(*) FILTER (m <> 0) AS n FROM t")
def masked_mean_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.masked_mean_of_all(tokens(spark, sf_dir), "r", "m").withColumn("mean", F.round("mean", 6))


@query("timing_reduce", "SELECT event_type AS name, round(avg(value), 6) AS seconds FROM events GROUP BY 1")
def timing_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    return metrics.reduce_timing(rows, "name", "seconds").withColumn("seconds", F.round("seconds", 6))


@query("response_info", f"""WITH {T}, s AS (SELECT seq, list(m ORDER BY ts, id) AS m FROM t GROUP BY 1), c AS (SELECT seq, m, len(m) // 3 AS k FROM s)
  SELECT seq, coalesce(list_sum(m[1:len(m) - k]), 0)::INT AS prompt_length, coalesce(list_sum(m[len(m) - k + 1:]), 0)::INT AS response_length FROM c""")  # fmt: skip
def response_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "m", "token").withColumn("responses", F.slice("token", 1, F.floor(F.size("token") / 3).cast("int")))
    return metrics.response_info(rows, "m", "responses").select("seq", "prompt_length", "response_length")


@query("preference_metrics", f"""WITH {R}, a AS (SELECT round(avg(reward), 4) AS s, max(reward) AS smax, round(avg(tax), 6) AS dl, round(avg((length >= 50000)::INT), 6) AS x, round(avg((num = 7)::INT), 6) AS clip FROM r)
  SELECT unnest(['actor/dpo_logits', 'reward/score/max', 'reward/score/mean', 'prompt_length/clip_ratio']) AS key, unnest([dl, smax, s, clip]) AS value FROM a""")  # fmt: skip
def preference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.preference_metrics(rollouts(spark, sf_dir), "reward", "disc", "tax", "disc", "tax", "length", "num", 50000, 7)
    digits = F.when(F.col("key") == "reward/score/mean", F.round("value", 4)).otherwise(F.round("value", 6))
    return out.where(F.col("key").isin("actor/dpo_logits", "reward/score/max", "reward/score/mean", "prompt_length/clip_ratio")).select("key", digits.alias("value"))


@query("batch_reverse_index", f"WITH {O} SELECT row_id AS place, (n.n - 1 - row_id) AS row_id FROM o, n")
def batch_reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    n = rows.count()
    out = batches.reverse_index(rows.select(F.col("row_id").alias("pos"), (F.lit(n) - 1 - F.col("row_id")).alias("row_id")))
    a, b = out.columns
    return out.select(F.col(a).alias("place"), F.col(b).alias("row_id"))


@query("sampler_orders", f"""WITH {O} SELECT row_id, row_number() OVER (ORDER BY md5('5:' || row_id), row_id) - 1 AS random, row_number() OVER (ORDER BY price, row_id) - 1 AS curriculum FROM o""")
def sampler_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("row_id", "price")
    by = lambda kind: batches.sampler_order(rows, kind, 5, "price").select("row_id", F.col("place").alias(kind))
    return by("random").join(by("curriculum"), "row_id")


@query("batch_append", """WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_name AS name FROM nation), b AS (SELECT r_name AS name FROM region WHERE length(r_name) > 4)
  SELECT row_id, name FROM a UNION ALL SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY name) - 1, name FROM b""")  # fmt: skip
def batch_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = batches.number(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey").select("row_id", "name")
    return batches.appended(old, table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), F.length("name") > 4)


@query("batch_union_maps", "SELECT o_orderkey AS key, o_orderpriority AS a, o_orderstatus AS b, 3::INT AS n FROM orders")
def batch_union_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("same"), F.lit("x"))
    two = F.create_map(F.lit("b"), F.col("o_orderstatus"), F.lit("same"), F.lit("x"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), batches.union_maps(one, two).alias("m"))
    return rows.select("key", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


@query("batch_from_columns", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, lang AS label, (n_chars / 2)::DOUBLE AS score FROM documents")
def batch_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns that come as tables of their own."""
    rows = batches.number(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return batches.zipped({"label": rows.select("row_id", F.col("lang").alias("value")), "score": rows.select("row_id", (F.col("n_chars") / 2).alias("value"))})


@query("shown_generations", "SELECT doc_id FROM documents ORDER BY md5('42:' || text), text LIMIT 20")
def shown_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 20 rows: the limit is the feature."""
    return sampling.shown(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "text", 20, 42).select("doc_id")


@query("shown_generations_table", """WITH s AS (SELECT unnest([1, 2]) AS step), d AS (SELECT step, doc_id, lang, row_number() OVER (PARTITION BY step ORDER BY md5('42:' || text), text) AS n FROM documents, s WHERE text IS NOT NULL AND (step = 2 OR n_chars % 2 = 0))
  SELECT step, doc_id, lang FROM d WHERE n <= 20""")  # fmt: skip
def shown_generations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two steps appended to one table; the first is written twice."""
    path, rows = _folder(spark, "shown"), table(spark, sf_dir, "documents").where("text is not null")
    for step, part in ((1, rows), (2, rows), (1, rows.where("n_chars % 2 = 0"))):
        datasets.append_step(sampling.shown(part.select("doc_id", "lang", "text"), "text", 20, 42).select("doc_id", "lang"), path, step)
    return spark.read.parquet(path).select("step", "doc_id", "lang")


@query("recoverability_records", """WITH l AS (SELECT d.doc_id, d.lang, regexp_extract_all(d.text, '[a-z]+') AS ws, row_number() OVER (PARTITION BY d.lang ORDER BY md5('7:' || d.doc_id), d.doc_id) AS n FROM documents d JOIN labels USING (doc_id) WHERE quality = 0),
  p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 1, 40)) AS place FROM l WHERE n <= 25) SELECT doc_id, place::BIGINT AS place, round((place + 1) / len(ws), 6) AS ratio, array_to_string(ws[: place + 1], ' ') AS prefix FROM p""")  # fmt: skip
def recoverability_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed answers, 25 of each language by a seeded sample, branched at every 40th word and written as lines of JSON."""
    failed = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select("doc_id", "lang", F.expr("regexp_extract_all(text, '[a-z]+', 0)").alias("words"))
    made = sampling.prefixes(sampling.bottom_k(failed, 25, 7, "doc_id", group="lang"), "words", 40)
    path = _folder(spark, "recoverability")
    for _ in range(2):
        datasets.append_step(made.select("doc_id", "place", "ratio", F.array_join("prefix", " ").alias("prefix")), path, 1, "json")
    return spark.read.schema("doc_id long, place long, ratio double, prefix string").json(f"{path}/step=1").withColumn("ratio", F.round("ratio", 6))


@query("batch_consistency", f"""WITH {O}, m AS (SELECT CASE WHEN key % 97 = 0 THEN NULL WHEN key % 89 = 0 THEN row_id - 1 ELSE row_id END AS row_id FROM o), c AS (SELECT row_id, count(*) AS n FROM m WHERE row_id IS NOT NULL GROUP BY 1), s AS (SELECT max(n) AS times, count(*) AS ids, min(row_id) AS least, max(row_id) AS most FROM c)
  SELECT 'price is double' AS "check", TRUE AS ok UNION ALL SELECT 'priority is bigint', FALSE UNION ALL SELECT 'mask is array<int>', FALSE UNION ALL SELECT 'row_id has no nulls', (SELECT count(*) = count(row_id) FROM m) UNION ALL SELECT 'row_id has no repeats', times = 1 FROM s
  UNION ALL SELECT 'row_id has no gaps', least = 0 AND most = ids - 1 FROM s UNION ALL SELECT 'ids is equally long', FALSE UNION ALL SELECT 'pair is equally long', TRUE""")  # fmt: skip
def batch_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with null and repeated numbers, gaps, and arrays of several lengths."""
    rows = _rows(spark, sf_dir).withColumns({"row_id": F.when(F.col("key") % 97 == 0, None).when(F.col("key") % 89 == 0, F.col("row_id") - 1).otherwise(F.col("row_id")), "ids": F.sequence(F.lit(0), F.col("key") % 3), "pair": F.array("key", "key")})
    return batches.consistency(rows, {"price": "double", "priority": "bigint", "mask": "array<int>"})


@query("batch_equal_columns", """WITH t AS (SELECT event_id, value, CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE ELSE value END AS v, event_type FROM events)
  SELECT * FROM (VALUES ('value', TRUE, TRUE), ('with_nan', TRUE, FALSE), ('kind', TRUE, TRUE)) AS x("column", equal, strict) UNION ALL SELECT 'one_off', (SELECT count(*) = 0 FROM events WHERE event_id = (SELECT max(event_id) FROM events)), FALSE""")  # fmt: skip
def batch_equal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch and a copy of it in another order, in which one column differs in one row: equal columns, and strictly equal ones, for which NaN isn't itself."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "value", F.expr("if(event_id % 50 = 0, double('NaN'), value)").alias("with_nan"), F.col("event_type").alias("kind"), F.col("user_id").alias("one_off"))
    last = rows.agg(F.max("row_id")).first()[0]
    other = rows.repartition(5, "kind").withColumn("one_off", F.col("one_off") + F.when(F.col("row_id") == last, 1).otherwise(0))
    columns = "value", "with_nan", "kind", "one_off"
    return batches.equal_columns(rows, other, *columns).join(batches.equal_columns(rows, other, *columns, nan_equal=False).withColumnRenamed("equal", "strict"), "column")


@query("batch_interleaved", f"""WITH {O}, p AS (SELECT o_orderkey AS key, o_totalprice AS price, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS source FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM p),
  w AS (SELECT *, (SELECT max(w) FROM range(6) t(w) WHERE w * m // 6 <= i) AS worker FROM r) SELECT row_number() OVER (ORDER BY worker, source, i) - 1 AS row_id, worker, source, key, CASE WHEN source = 2 THEN -1.0::DOUBLE ELSE price END AS price FROM w""")  # fmt: skip
def batch_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as three parts, the last without a price, dealt to six workers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.expr("case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end").alias("source"))
    parts = [batches.number(orders.where(F.col("source") == i).drop(*["price"] * (i == 2)), "key") for i in range(3)]
    return batches.interleaved(parts, [p.count() for p in parts], 6, {"price": -1.0}).select("row_id", "worker", "source", "key", "price")


@query("sample_branch_points", """WITH u AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('9:' || user_id || ':' || event_id)[1:12], event_id) AS n FROM events WHERE event_type <> 'error') SELECT user_id, event_id FROM u WHERE n <= 3""")
def sample_branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sampling.branch_points(rows, "user_id", "event_id", F.col("event_type") != "error", 3, 9).select("user_id", "event_id")


@query("tokens_trimmed", f"""WITH {T}, s AS (SELECT seq, list(token ORDER BY ts, id) AS a FROM t GROUP BY 1) SELECT seq, array_to_string(a[1:4], ',') AS head, array_to_string(CASE WHEN len(a) > 8 THEN a[-4:] ELSE a[5:] END, ',') AS tail, len(a)::INT AS n,
  array_to_string(a[1:6], ',') AS cut, CASE WHEN length(array_to_string(a, ',')) > 12 THEN left(array_to_string(a, ','), 12) || '...' ELSE array_to_string(a, ',') END AS text FROM s""")  # fmt: skip
def tokens_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    t = sequences(spark, sf_dir, "token").select("seq", tk.trim("token", 8).alias("t"), tk.truncate("token", "token", 6, 6).alias("c"), tk.trim_text(joined(F.col("token")), 12).alias("text"))
    return t.select("seq", joined(F.col("t.head")).alias("head"), joined(F.col("t.tail")).alias("tail"), F.col("t.n").alias("n"), joined(F.col("c.ids")).alias("cut"), "text")


@query("tokens_unpadded", f"WITH {T}, s AS (SELECT seq, list(token ORDER BY ts, id) AS a FROM t GROUP BY 1) SELECT seq, array_to_string(a, ',') AS ids FROM s")
def tokens_unpadded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "token").withColumn("mask", F.concat(F.array_repeat(F.lit(0), 5), F.transform("token", lambda x: F.lit(1))))
    padded = rows.withColumn("ids", F.concat(F.array_repeat(F.lit(0).cast("long"), 5), "token"))
    return padded.select("seq", F.array_join(tk.strip_left_pad("ids", "mask").cast("array<string>"), ",").alias("ids"))


@query("tokens_supervised_mask", f"""WITH {T}, s AS (SELECT seq, list(token ORDER BY ts, id) AS a FROM t GROUP BY 1), c AS (SELECT seq, a, len(a) // 2 AS p, len(a) - len(a) // 2 AS r FROM s),
  e AS (SELECT seq, p, r, unnest(range(len(a) + 4)) AS i FROM c) SELECT seq, sum(CASE WHEN i >= p + r OR (p > 1 AND i < p - 1) OR i = p + r - 1 OR (i >= greatest(p - 1, 0) AND i < greatest(p - 1, 0) + least(2, r)) THEN 0 ELSE 1 END)::INT AS kept FROM e GROUP BY 1""")  # fmt: skip
def tokens_supervised_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "token").withColumn("p", F.floor(F.size("token") / 2).cast("int"))
    rows = rows.withColumn("r", F.size("token") - F.col("p")).withColumn("answer", F.slice("token", F.col("p") + 1, F.greatest(F.col("r"), F.lit(1)))).withColumn("prefix", F.concat(F.slice("answer", 1, 2), F.array(F.lit(-1).cast("long"))))
    rows = rows.withColumn("mask", F.concat(F.transform("token", lambda x: F.lit(1)), F.array_repeat(F.lit(0), 4)))
    made = tk.supervised_mask("mask", F.col("p"), F.col("r"), "prefix", "answer")
    return rows.select("seq", F.aggregate(made, F.lit(0), lambda a, x: a + x).alias("kept"))


@query("tree_contexts", f"""WITH RECURSIVE {N}, d AS (SELECT node, max(distance)::INT AS depth FROM up GROUP BY 1), b AS (SELECT ancestor AS node, count(*) - 1 AS descendants, max(depth) AS deepest FROM up JOIN d USING (node) GROUP BY 1),
  l AS (SELECT node, string_agg(ancestor, '/' ORDER BY distance DESC) AS lineage FROM up WHERE distance < 2 GROUP BY 1) SELECT node, depth, lineage, greatest(depth - 1, 0)::INT AS lineage_cut, descendants, deepest FROM d JOIN b USING (node) JOIN l USING (node)""")  # fmt: skip
def tree_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.contexts(_nodes(spark, sf_dir), 2).withColumn("lineage", F.array_join("lineage", "/"))


@query("registry_estimators", f"""WITH {R} SELECT 'rloo' AS name, round(sum(CASE WHEN n > 1 THEN reward - (s - reward) / (n - 1) ELSE 0 END), 2) AS total FROM (SELECT reward, count(*) OVER w AS n, sum(reward) OVER w AS s FROM r WINDOW w AS (PARTITION BY uid))
  UNION ALL SELECT 'sibling_mean', round(sum(abs(reward - m)), 2) FROM (SELECT reward, avg(reward) OVER (PARTITION BY uid) AS m FROM r)""")  # fmt: skip
def registry_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir)
    group = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"))
    rloo = advantages.compute_advantage("rloo", rows).join(group, "uid").agg(F.round(F.sum(F.when(F.col("_n") > 1, F.col("advantage")).otherwise(0.0)), 2).alias("total"))
    siblings = advantages.compute_advantage("sibling_mean", rows).agg(F.round(F.sum(F.abs("advantage")), 2).alias("total"))
    return rloo.select(F.lit("rloo").alias("name"), "total").unionAll(siblings.select(F.lit("sibling_mean").alias("name"), "total"))


@query("registry_names", "SELECT unnest(['estimator', 'policy_loss', 'reward_manager', 'kl_controller']) AS kind, TRUE AS known, TRUE AS refused")
def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each registry knows a name of its kind and refuses another."""
    rows = []
    for kind, registry, name in (("estimator", ESTIMATORS, "rloo"), ("policy_loss", POLICY_LOSSES, "clip_cov"), ("reward_manager", REWARD_MANAGERS, "naive"), ("kl_controller", KL_CONTROLLERS, "adaptive")):
        try:
            registry.get(f"no {name}")
            refused = False
        except ValueError:
            refused = True
        rows.append((kind, callable(registry.get(name)), refused))
    return spark.createDataFrame(rows, "kind string, known boolean, refused boolean")


@query("registry_dispatch", """SELECT doc_id, CASE lang WHEN 'en' THEN n_chars WHEN 'de' THEN -n_chars WHEN 'fr' THEN doc_id ELSE 0 END::DOUBLE AS score FROM documents""")
def registry_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function a language, registered by name and chosen by each row; one name is registered again and replaced."""
    scores = Registry("score", strict=False)
    scores.register("en")(lambda n, i: n.cast("double"))
    scores.register("de")(lambda n, i: n.cast("double"))
    scores.register("de")(lambda n, i: -n.cast("double"))
    scores.register("fr")(lambda n, i: i.cast("double"))
    scores.register("es")(lambda n, i: F.lit(0.0))
    return table(spark, sf_dir, "documents").select("doc_id", scores.dispatch(F.col("lang"), F.col("n_chars"), F.col("doc_id")).alias("score"))


@query("reward_custom", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM documents")
def reward_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer from a file, behind a manager chosen by name."""
    scorer = rewards.load_scorer(g.__file__, "number_or_text", relative=1e-5)
    manager = rewards.load_manager("dapo", lambda a, t: scorer(a, t).cast("double"), most=100, buffer=10, factor=1.0)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".0").otherwise("9")).alias("response"), F.col("n_chars").cast("string").alias("truth"), F.lit(5).alias("length"))
    return manager(rows).select("doc_id", "reward")


@query("source_pairs", "SELECT text AS prompt, lang AS response, NULL::VARCHAR AS prefix FROM documents")
def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.read_pairs(spark, [f"{sf_dir}/documents.parquet"], "text", "lang")


@query("source_prompts", "SELECT vec_id FROM embeddings WHERE len(embedding) <= 64")
def source_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.read_prompts(spark, [f"{sf_dir}/embeddings.parquet"], "embedding", 64).select("vec_id")


@query("sink_steps", "SELECT doc_id, n_chars, (doc_id % 3)::INT AS step FROM documents")
def sink_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written a folder a step, twice into one folder, and read again."""
    path, rows = _folder(spark, "steps"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 3).cast("int").alias("step"))
    datasets.write_steps(rows.where("step < 2"), path)
    datasets.write_steps(rows.where("step = 2"), path)
    return spark.read.schema("doc_id long, n_chars long, step int").json(path)


@query("sink_batch", "SELECT doc_id, source, 'weekly' AS name FROM documents")
def sink_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "batch")
    datasets.save_batch(table(spark, sf_dir, "documents").select("doc_id", "source"), path, {"name": "weekly"})
    rows, meta = datasets.load_batch(spark, path)
    return rows.withColumn("name", F.lit(meta["name"]))


@query("sink_verify", "SELECT TRUE AS same, TRUE AS differs")
def sink_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with the same files has no difference, one with another file has."""
    one, two = _folder(spark, "copy"), _folder(spark, "copy")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")).coalesce(1)
    rows.write.text(one)
    rows.limit(3).coalesce(1).write.text(two)
    same, other = datasets.same_files(spark, one, one).isEmpty(), datasets.same_files(spark, one, two).isEmpty()
    return spark.createDataFrame([(same, not other)], "same boolean, differs boolean")


@query("source_counting", "SELECT doc_id AS index, TRUE AS right FROM documents")
def source_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic counting prompt a document; its truth is counted again from the prompt."""
    rows = datasets.counting_prompts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index")), 3)
    word, letter = F.regexp_extract("prompt", r"word ([a-z-]+)\?", 1), F.regexp_extract("prompt", "many ([a-z])", 1)
    counted = F.size(F.filter(F.split(word, "-"), lambda x: x == letter))
    return rows.select("index", ((counted == F.col("truth")) & F.size(F.split(word, "-")).between(3, 5)).alias("right"))


@query("source_files", """WITH k AS (SELECT n_regionkey AS r, CASE n_regionkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'md' END AS kind, sum(length(n_name) + 1) AS n FROM nation GROUP BY 1, 2) SELECT r::INT AS region, kind, n::BIGINT AS length FROM k WHERE r <> 4""")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder by their endings: nations written as lines, a folder a region, one of which has an ending that isn't asked for."""
    root, nations = _folder(spark, "files"), table(spark, sf_dir, "nation")
    for r in range(5):
        kind = "txt" if r == 4 else ("csv", "json", "md")[r % 3]
        lines = nations.where(F.col("n_regionkey") == r).select("n_name").repartition(1)
        lines.write.option("fileExtension", kind).option("extension", kind).csv(f"{root}/{r}/{kind}")
    files = datasets.files_of(spark, root, "part-*")
    named = files.select(F.regexp_extract("path", r"/(\d)/(\w+)/part-", 1).cast("int").alias("region"), F.regexp_extract("path", r"/(\d)/(\w+)/part-", 2).alias("kind"), "length")
    return named.where("kind in ('csv', 'json', 'md')").groupBy("region", "kind").agg(F.sum("length").alias("length"))
