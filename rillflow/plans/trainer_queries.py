"""Queries: training rows of trees, teacher continuations, process scores, pool snapshots and phases, feedback of streams, and routed graders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import grading as g
from rillflow.functions import tokens as tk
from rillflow.operators import balance, metrics, rewards, sampling, trace, trees
from rillflow.operators.tables import cut
from rillflow.plans.bindings import R, T, rollouts, sequences
from rillflow.plans.catalog import query, table
from rillflow.plans.state_queries import N, P, _leaves, _nodes, _pool, _seen
from rillflow.plans.table_queries import _folder
from rillflow.sources import datasets
from rillflow.streaming import pools


@query("tree_packages", f"""WITH RECURSIVE {N}, s AS (SELECT up.node, distance, ancestor, length(ancestor) AS l FROM up WHERE up.node LIKE 'c%' AND ancestor NOT LIKE 'r%'),
  q AS (SELECT node, string_agg(ancestor, '' ORDER BY distance DESC) AS path, max(l) FILTER (distance = 1) AS a, max(l) FILTER (distance = 0) AS b FROM s GROUP BY 1)
  SELECT node, left(path, 6) AS ids, reward, round((least(a, 6) * a + least(b, greatest(0, 6 - a)) * b) / 10.0::DOUBLE / least(a + b, 6), 6) AS advantage FROM q JOIN leaf USING (node)""")  # fmt: skip
def tree_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment is the characters of its node, none for a root; its process reward a tenth of their number."""
    nodes = _nodes(spark, sf_dir).withColumns({"ids": F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.split("node", ""), lambda x: x != "")), "process": F.length("node") / 10})
    out = trees.packages(nodes, _leaves(spark, sf_dir), 6)
    return out.select("node", F.array_join("ids", "").alias("ids"), "reward", F.round("advantage", 6).alias("advantage"))


@query("reward_attach_teacher", f"""WITH {T}, s AS (SELECT seq, least(count(*), 8) AS n FROM t GROUP BY 1), k AS (SELECT seq, n, least(seq % 9, n) AS m, seq % 4 AS x, seq % 3 <> 0 AS there FROM s),
  w AS (SELECT seq, n, m, x, CASE WHEN NOT there THEN 'no_teacher' WHEN m < 2 THEN 'short_match' WHEN m / n::DOUBLE < 0.5 THEN 'low_ratio' WHEN x < 1 THEN 'short_suffix' WHEN m + x > 9 THEN 'too_long' WHEN 9 - (m + x) < 1 THEN 'no_room' WHEN seq % 5 = 0 THEN 'low_reward' END AS why, there FROM k)
  SELECT seq, CASE WHEN there THEN m ELSE 0 END::INT AS match, why AS skip_reason, CASE WHEN why IS NULL THEN m + x ELSE n END::INT AS tokens FROM w""")  # fmt: skip
def reward_attach_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teachers of two thirds of the sequences, each with an older continuation that must not count."""
    students = sequences(spark, sf_dir, "token").select("seq", F.slice("token", 1, 8).alias("ids"))
    seq, end = F.col("seq"), F.array(F.lit(-1).cast("long"))
    newest = students.where("seq % 3 <> 0").select(
        "seq", F.concat(F.slice("ids", F.lit(1), (seq % 9).cast("int")), end).alias("teacher"), F.array_repeat(F.lit(-2).cast("long"), (seq % 4).cast("int")).alias("suffix"), (seq % 5).cast("double").alias("reward"), F.lit(2).alias("step")
    )
    teachers = newest.unionAll(newest.select("seq", end.alias("teacher"), end.alias("suffix"), F.lit(9.0).alias("reward"), F.lit(1).alias("step")))
    out = rewards.attach_teacher(students, teachers, "seq", 2, 0.5, 1, 9, 1)
    return out.select("seq", "match", "skip_reason", F.size("ids").alias("tokens"))


@query("reward_process_scores", f"""WITH {T}, c AS (SELECT seq, count(*) AS c FROM t GROUP BY 1), q AS (SELECT seq, pos, (new - ref) * 0.05::DOUBLE AS q, greatest(c - 2, 1) AS n FROM t JOIN c USING (seq)),
  l AS (SELECT seq, pos, n, CASE WHEN pos = n - 1 THEN seq % 2 - coalesce(sum(q) FILTER (pos < n - 1) OVER (PARTITION BY seq), 0) WHEN pos < n THEN q ELSE 0 END AS f FROM q),
  d AS (SELECT x.seq, x.pos, sum(y.f * 0.9::DOUBLE ** (y.pos - x.pos)) AS r FROM l x JOIN l y ON x.seq = y.seq AND y.pos >= x.pos WHERE x.pos < x.n - 1 GROUP BY 1, 2)
  SELECT c.seq, round(coalesce(sum(r), 0), 5) AS total, round(coalesce(max(r) FILTER (pos = 0), 0), 5) AS first FROM c LEFT JOIN d ON d.seq = c.seq GROUP BY 1""")  # fmt: skip
def reward_process_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "new", "ref")
    n = F.greatest(F.size("new") - 2, F.lit(1))
    scored = rows.select("seq", rewards.process_scores(F.col("new"), F.col("ref"), n, 0.05, 0.9, (F.col("seq") % 2).cast("double")).alias("r"))
    return scored.select("seq", F.round(tk.total("r"), 5).alias("total"), F.round(F.get("r", F.lit(0)), 5).alias("first"))


@query("reward_implicit_scores", f"""WITH {T}, c AS (SELECT seq, count(*) AS c FROM t GROUP BY 1)
  SELECT seq, round(coalesce(sum((new - ref) * 0.05::DOUBLE) FILTER (pos < greatest(c - 2, 1) - 1), 0), 6) AS total FROM t JOIN c USING (seq) GROUP BY 1""")  # fmt: skip
def reward_implicit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "new", "ref")
    scored = rewards.process_scores(F.col("new"), F.col("ref"), F.greatest(F.size("new") - 2, F.lit(1)), 0.05)
    return rows.select("seq", F.round(tk.total(scored), 6).alias("total"))


#: Graded texts by ``doc_id % 6``, with ``N`` for the number of characters and ``M`` for one more: (source, text).
_ROUTED = (
    ("gsm", "so 3 apples. #### N"), ("gsm", "#### M"), ("search", "<answer>x</answer> no, <answer> The N! </answer>"), ("search", "<answer>M</answer>"), ("boxed", "thus \\boxed{N}"), ("boxed", "\\boxed{N} or \\boxed{M}"),
)


@query("grade_routed", r"""WITH k AS (SELECT doc_id, n_chars::VARCHAR AS n, (n_chars + 1)::VARCHAR AS m FROM documents), """ + "t AS (SELECT doc_id, n, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(_ROUTED)) + " END AS source, replace(replace(CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, (_, x) in enumerate(_ROUTED)) + r""" END, 'N', n), 'M', m) AS text FROM k)
  SELECT doc_id, CASE source WHEN 'gsm' THEN (regexp_extract_all(text, '(-?[0-9.,]+)', 1)[-1] = n)::INT WHEN 'search' THEN (trim(regexp_replace(regexp_replace(lower(regexp_extract_all(text, '<answer>(.*?)</answer>', 1)[-1]), '[^\w\s]', '', 'g'), '\b(a|an|the)\b', ' ', 'g')) = n)::INT
    ELSE CASE WHEN regexp_extract_all(text, '\\boxed\{(.*?)\}', 1)[-1] = n THEN 1 ELSE -1 END END::DOUBLE AS score FROM t""")  # fmt: skip
def grade_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources with a grader each; the SQL takes the answers out of the same texts by patterns of its own."""
    kind, n = F.col("doc_id") % 6, F.col("n_chars").cast("string")
    m = (F.col("n_chars") + 1).cast("string")
    pick = lambda side: F.coalesce(*[F.when(kind == i, F.lit(p[side])) for i, p in enumerate(_ROUTED)])
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), pick(0).alias("source"), F.replace(F.replace(pick(1), F.lit("N"), n), F.lit("M"), m).alias("text"))
    text, truth = F.col("text"), F.col("n")
    graders = {("gsm", "gsm8k"): g.number_score(text, truth).reward, "search": g.tag_score(text, F.array(truth)), "boxed": g.strict_box(text, truth)}
    return rows.select("doc_id", rewards.by_source(F.col("source"), graders).alias("score"))


@query("grade_verdict", "SELECT doc_id, (doc_id % 2)::DOUBLE AS score FROM documents")
def grade_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (F.col("doc_id") % 2).cast("string")
    reply = F.concat(F.lit("Final Score: 7 at first.\n"), F.when(F.col("doc_id") % 3 == 0, "### ").otherwise(""), F.lit("final  score : "), last, F.when(F.col("doc_id") % 5 == 0, ".0").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", g.verdict(reply).alias("score"))


@query("checkpoint_due", "SELECT event_id, (event_id % 200 - 10 > 0 AND value > 0 AND event_id % 200 - 10 <= value + 60 + 5) AS due FROM events")
def checkpoint_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", metrics.checkpoint_due((F.col("event_id") % 200 - 10).cast("double"), F.col("value"), 60.0, 5.0).alias("due"))


_D = f"""{R}, o AS (SELECT uid, reward / 50 AS s, (length % 2)::INT AS acc, count(*) OVER w AS n, cume_dist() OVER (PARTITION BY uid ORDER BY reward / 50) AS share,
   avg(reward / 50) FILTER (length % 2 = 0) OVER w AS bad, avg(reward / 50) FILTER (length % 2 = 1) OVER w AS good FROM r WINDOW w AS (PARTITION BY uid)),
  l AS (SELECT n, share, ln(1 + exp(-(0.5::DOUBLE * (s - coalesce(CASE WHEN acc = 1 THEN bad ELSE good END, 0)) * (2 * acc - 1)))) AS loss FROM o)"""


@query("detached_pair_loss", f"WITH {_D} SELECT 'none' AS mode, round(avg(loss), 6) AS loss FROM l UNION ALL SELECT 'best_of', round(sum(loss * n * share ** (n - 1)), 2) FROM l")
def detached_pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir).select("uid", (F.col("reward") / 50).alias("s"), (F.col("length") % 2).cast("int").alias("acc"))
    loss = lambda mode, best, digits: metrics.detached_pair_loss(rows, "uid", "s", "acc", 0.5, best).select(F.lit(mode).alias("mode"), F.round("loss", digits).alias("loss"))
    return loss("none", None, 6).unionAll(loss("best_of", "s", 2))


@query("sample_branch_utility", """WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  k AS (SELECT *, (('0x' || md5('4:' || user_id || ':' || place)[1:12])::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u, ((place + 1) / n::DOUBLE) ** 0.1::DOUBLE AS w FROM c WHERE event_type <> 'error')
  SELECT user_id, place, round(w, 6) AS weight FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ln(u) / w DESC, place) <= 2""")  # fmt: skip
def sample_branch_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before there is a model of success."""
    return sampling.branch_utility(_chain(spark, sf_dir), "seq", "place", "length", F.col("kind") != "error", 2, 4).select(F.col("seq").alias("user_id"), "place", F.round("weight", 6).alias("weight"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, "kind")
    return rows.select("seq", F.size("kind").alias("length"), F.posexplode("kind").alias("place", "kind")).withColumn("place", F.col("place").cast("long"))


@query("sample_branch_model")
def sample_branch_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a model of success by place, fitted on how earlier branches ended."""
    chain = _chain(spark, sf_dir)
    model = metrics.fit_logistic(chain.select(((F.col("place") + 1) / F.col("length")).alias("x"), (F.col("kind") == "purchase").cast("int").alias("y")), "x", "y")
    return sampling.branch_utility(chain, "seq", "place", "length", F.col("kind") != "error", 2, 4, model).select(F.col("seq").alias("user_id"), "place", F.round("weight", 6).alias("weight"))


@query("pool_checkpoint", f"WITH {P} SELECT 'nodes' AS kind, count(*) AS n, 0 AS in_flight, sum(node)::BIGINT AS keys FROM p UNION ALL SELECT 'events', count(*), 0, sum(parent)::BIGINT FROM e")
def pool_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool is saved while half of its events are with a teacher; loaded, all are queued."""
    path, events = _folder(spark, "pool"), pools.failures(_seen(spark, sf_dir)).withColumn("in_flight", F.col("parent") % 2 == 0)
    pools.save_state(_pool(spark, sf_dir), events, path)
    nodes, events = pools.load_state(spark, path)
    sums = lambda df, kind, flag, key: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(flag).cast("int").alias("in_flight"), F.sum(key).alias("keys"))
    return sums(nodes, "nodes", F.lit(False), "node").unionAll(sums(events, "events", F.col("in_flight"), "parent"))


_E = f"""{P}, f AS (SELECT * FROM p WHERE parent IS NOT NULL AND created BETWEEN 10 AND 30), r AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY created, node) AS round FROM f),
  b AS (SELECT sum(c // 64 * 64) AS taken FROM (SELECT count(*) AS c FROM r GROUP BY round)), a AS (SELECT count(*) AS nodes, count(DISTINCT tree) AS trees FROM f),
  x AS (SELECT a.nodes, a.trees, b.taken, (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM e WHERE parent % 2 = 0) AS flying, (SELECT count(*) FROM (SELECT tree FROM p GROUP BY 1 HAVING NOT bool_or(active))) AS dead FROM a, b),
  y AS (SELECT *, CASE WHEN trees >= 64 THEN taken * 2 ELSE 0 END AS sampled FROM x)"""
_EPOCH = {"snapshot_nodes": "nodes", "snapshot_trees": "trees", "events_cleared": "events", "events_cleared_pending": "events - flying", "events_cleared_in_flight": "flying", "trees_cleaned": "dead", "sampled_entries": "sampled", "sample_batches": "sampled // 64",
          "dropped_entries": "CASE WHEN trees >= 64 THEN nodes * 2 - sampled ELSE 0 END", "waiting_for_full_batch": "(trees < 64 AND nodes > 0)::INT", "needed_for_next_batch": "CASE WHEN trees < 64 AND nodes > 0 THEN 64 - trees ELSE 0 END"}


@query("pool_epoch_phase", f"WITH {_E} " + " UNION ALL ".join(f"SELECT '{k}' AS key, ({v})::DOUBLE AS value FROM y" for k, v in _EPOCH.items()))
def pool_epoch_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = pools.failures(_seen(spark, sf_dir)).withColumn("in_flight", F.col("parent") % 2 == 0)
    return pools.epoch_phase(_pool(spark, sf_dir), events, 10, 30, 64, 2)


@query("pool_debug_records", f"""WITH {P}, q AS (SELECT l_orderkey AS node, l_linenumber AS tid, 't' || o_custkey AS tree FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1), w AS (SELECT tree, parent AS node, count(*) AS events FROM e GROUP BY 1, 2)
  SELECT q.node, q.tree, p.node IS NOT NULL AS known, p.parent, coalesce(w.events, 0) AS events FROM q LEFT JOIN p ON p.tree = q.tree AND p.node = q.node LEFT JOIN w ON w.tree = q.tree AND w.node = q.node""")  # fmt: skip
def pool_debug_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and read again."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("tid"))
    samples = lines.join(table(spark, sf_dir, "orders").selectExpr("o_orderkey as node", "concat('t', o_custkey) as tree"), "node")
    path = _folder(spark, "debug")
    pools.debug_records(_pool(spark, sf_dir), pools.failures(_seen(spark, sf_dir)), samples).write.json(path)
    return spark.read.schema("node long, tree string, known boolean, state struct<parent:long>, events long").json(path).select("node", "tree", "known", "state.parent", "events")


@query("stream_feedback", "SELECT 'again ' || n_name AS prompt, n_nationkey AS key FROM nation WHERE n_nationkey % 2 = 0")
def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of a stream makes new prompts; what it appended is the result."""
    path = _folder(spark, "feedback")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    rows.repartition(3, "key").write.parquet(f"{path}/seen")
    stream = spark.readStream.schema("key long, name string").option("maxFilesPerTrigger", 1).parquet(f"{path}/seen")
    pools.feedback(stream, f"{path}/made", f"{path}/state", lambda batch: batch.where("key % 2 = 0").select(F.concat(F.lit("again "), "name").alias("prompt"), "key"))
    return spark.read.schema("prompt string, key long, batch int").parquet(f"{path}/made").select("prompt", "key")


@query("sink_metrics", "SELECT event_type AS key, round(avg(value), 6) AS value, (s.step)::INT AS step FROM events, (SELECT unnest([1, 2]) AS step) s GROUP BY ALL")
def sink_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table of two steps, of which one is written twice."""
    path = _folder(spark, "metrics")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.round(F.avg("value"), 6).alias("value"))
    for step in (1, 2, 1):
        datasets.append_metrics(rows, path, step)
    return spark.read.schema("key string, value double, step int").parquet(path)


@query("dataset_contest", """SELECT o_orderkey AS key, 2::INT AS cases, 'in' || o_custkey AS first, o_orderstatus = 'O' AS given FROM orders
  WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1995-01-01T00:00:00' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1997-01-00T00:00:00'""")  # fmt: skip
def dataset_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = lambda kind: F.concat(F.lit('[{"input": "' + kind), F.col("o_custkey").cast("string"), F.lit('", "output": "x"}]'))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), case("in").alias("public"), case("more").alias("private"), F.lit(" q ").alias("prompt"), F.when(F.col("o_orderstatus") == "O", "def f():").alias("starter")
    )
    out = datasets.contest_rows(rows, "date", "1995-01-01T00:00:00", "1997-01-00T00:00:00", "public", "private", "prompt", "starter")
    return out.select("key", F.size("inputs").alias("cases"), F.get("inputs", F.lit(0)).alias("first"), "given")


@query("dataset_checked_split", """SELECT doc_id, CASE WHEN ('0x' || md5('7:' || doc_id)[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 5 NOT IN (0, 1)""")
def dataset_checked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 5 == 1, "  ").otherwise(F.col("lang")).alias("truth"))
    return datasets.checked_split(rows, "doc_id", "truth", 0.1, 7).select("doc_id", "split")


@query("balance_micro_batch_rows")
def balance_micro_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each batch in the order of their micro-batches."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 16 as batch", "p_partkey as item", "cast(p_size as bigint) as length")
    return balance.reordered(balance.micro_batch_rows(rows, "batch", "item", "length", 300, divisor=4), "batch", "item")


@query("grade_nodes", """WITH k AS (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN 'gsm' WHEN 4 THEN 'unheard of' ELSE 'words' END AS source, doc_id % 5 <> 4 AND doc_id % 7 > 1 AS over, CASE doc_id % 3 WHEN 0 THEN '#### ' || n_chars WHEN 1 THEN '#### ' || (n_chars + 1) ELSE 'none' END AS t FROM documents)
  SELECT doc_id, CASE WHEN NOT over THEN 0 WHEN source = 'gsm' THEN (t = '#### ' || n_chars)::INT ELSE (t <> 'none')::INT / 2 END::DOUBLE AS reward, (over AND t <> 'none')::INT AS completed, over::INT AS finished FROM k""")  # fmt: skip
def grade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of which some were cut off, among them all of a source that has no grader."""
    kind, n = F.col("doc_id") % 5, F.col("n_chars").cast("string")
    source = F.when(kind == 0, "gsm").when(kind == 4, "unheard of").otherwise("words")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#### "), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("#### "), (F.col("n_chars") + 1).cast("string"))).otherwise("none")
    score = g.number_score(text, n)
    graders = {"gsm": score.reward, "words": score.completed / 2}
    node = rewards.node_score((kind != 4) & (F.col("doc_id") % 7 > 1), source, graders, score.completed)
    return table(spark, sf_dir, "documents").select("doc_id", node.alias("s")).select("doc_id", "s.*")


@query("trace_rows", """WITH d AS (SELECT * FROM documents WHERE n_chars >= 200), g AS (SELECT lang, count(*) AS n FROM d GROUP BY 1), x AS (SELECT 0::BIGINT AS call, 'long_enough' AS op, 'least=200' AS inputs, unnest(['rows', 'chars']) AS metric, unnest([count(*), sum(n_chars)])::DOUBLE AS value FROM d
  UNION ALL SELECT 1, 'by_language', '', unnest(['rows', 'most']), unnest([count(*), max(n)])::DOUBLE FROM g) SELECT call::INT AS call, op, inputs, metric, value, (SELECT count(*) FROM g) AS languages FROM x""")  # fmt: skip
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two operators watched while their result is written; what they saw, beside the size of the result."""
    seen = trace.Trace({"step": "1"})

    @seen.op(chars=F.sum("n_chars"))
    def long_enough(rows: DataFrame, least: int = 200) -> DataFrame:
        return rows.where(F.col("n_chars") >= least)

    @seen.op(most=F.max("n"))
    def by_language(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

    result = cut(by_language(long_enough(table(spark, sf_dir, "documents"))), "traced")
    return seen.table(spark).join(F.broadcast(result.agg(F.count(F.lit(1)).alias("languages")))).select("call", "op", "inputs", "metric", "value", "languages")
