"""Queries: trees, curriculum pools and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators import trees
from rillflow.sources import chat, datasets
from rillflow.streaming import pools
from rillflow.plans.bindings import sequences
from rillflow.plans.catalog import query, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region → nation → customer as an adjacency table."""
    t = lambda n: table(spark, sf_dir, n)
    r = t("region").selectExpr("concat('r', r_regionkey) as node", "cast(null as string) as parent")
    n = t("nation").selectExpr("concat('n', n_nationkey) as node", "concat('r', n_regionkey) as parent")
    c = t("customer").selectExpr("concat('c', c_custkey) as node", "concat('n', c_nationkey) as parent")
    return r.unionAll(n).unionAll(c)


N = """n AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
  up AS (SELECT node, node AS ancestor, 0 AS distance FROM n UNION ALL SELECT up.node, n.parent, distance + 1 FROM up JOIN n ON up.ancestor = n.node WHERE n.parent IS NOT NULL),
  leaf AS (SELECT 'c' || c_custkey AS node, c_acctbal AS reward FROM customer), v AS (SELECT ancestor AS node, count(*) AS leaves, avg(reward) AS value FROM up JOIN leaf USING (node) GROUP BY 1)"""


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as node", "c_acctbal as reward")


@query("tree_depths", f"WITH RECURSIVE {N} SELECT node, max(distance)::INT AS depth FROM up GROUP BY 1")
def tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.depths(_nodes(spark, sf_dir))


@query("tree_values", f"WITH RECURSIVE {N} SELECT node, leaves, round(value, 4) AS value FROM v")
def tree_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.values(_nodes(spark, sf_dir), _leaves(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query("tree_process_rewards", f"""WITH RECURSIVE {N}, root AS (SELECT node, ancestor AS root FROM up WHERE ancestor LIKE 'r%')
  SELECT n.node, round((2 * v.value - r.value - p.value) / sqrt(v.leaves), 4) AS process FROM n JOIN v ON v.node = n.node JOIN v p ON p.node = n.parent JOIN root ON root.node = n.node JOIN v r ON r.node = root.root""")  # fmt: skip
def tree_process_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    ladder = trees.Ladder(nodes)
    return trees.process_rewards(nodes, trees.values(nodes, _leaves(spark, sf_dir), ladder), ladder.roots().select("node", "root")).withColumn("process", F.round("process", 4))


@query("tree_leaf_paths", f"WITH RECURSIVE {N} SELECT node, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM up WHERE node LIKE 'c%' GROUP BY 1")
def tree_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.leaf_paths(_nodes(spark, sf_dir), _leaves(spark, sf_dir)).select("node", F.array_join("path", "/").alias("path"))


@query("tree_deepest", f"""WITH RECURSIVE {N}, d AS (SELECT node, max(distance)::INT AS depth FROM up GROUP BY 1), k AS (SELECT parent AS node, count(*) AS children FROM n WHERE parent IS NOT NULL GROUP BY 1)
  SELECT node, depth, coalesce(children, 0) AS children FROM d LEFT JOIN k USING (node) ORDER BY depth DESC, children DESC NULLS LAST, node DESC LIMIT 20""")  # fmt: skip
def tree_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.deepest(_nodes(spark, sf_dir), 20)


@query("tree_chains", """SELECT user_id AS chain, count(*)::INT AS n, sum(event_id)::BIGINT AS total, arg_max(value, event_id) AS reward FROM events GROUP BY 1""")
def tree_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("at"), F.array("event_id").alias("ids"), F.col("value").alias("reward"))
    out = trees.chains(parts, "chain", "at", "ids", "reward")
    return out.select("chain", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "reward")


@query("tree_entropy_candidates", """WITH t AS (SELECT user_id, event_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, -(event_id % 97) / 50.0::DOUBLE AS logp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, pos::INT AS pos FROM t WHERE pos >= ceil(n * 0.05::DOUBLE) AND pos < n - 10 ORDER BY logp, user_id, pos LIMIT 50""")  # fmt: skip
def tree_entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("logp", F.expr("-(event_id % 97) / 50.0D"))
    return trees.entropy_candidates(rows, "user_id", ["ts", "event_id"], "logp", 50).select("user_id", "event_id", F.col("pos").cast("int").alias("pos"))


# Pools: a tree is a customer, its nodes orders, its observations the orders' lines.

P = """p AS (SELECT 't' || o_custkey AS tree, o_orderkey AS node, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN NULL ELSE min(o_orderkey) OVER (PARTITION BY o_custkey) END AS parent,
    o_orderkey % 4 <> 0 AS active, o_orderkey % 50 AS created, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey % 40 END AS last_rollout, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 30 END AS last_sft,
    o_orderkey % 4 AS k_succ, 4 AS k_total FROM orders),
  s AS (SELECT 't' || o_custkey AS tree, o_orderkey AS node, count(*) FILTER (l_quantity > 25) AS k_succ, count(*) AS k_total, 60 AS step FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
  e AS (SELECT sha1(tree || ':' || node || ':' || step) AS event, tree, node AS parent, step AS created FROM s WHERE k_succ < k_total)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").withColumn("root", root).selectExpr(
        "concat('t', o_custkey) as tree", "o_orderkey as node", "if(o_orderkey = root, null, root) as parent", "o_orderkey % 4 <> 0 as active", "o_orderkey % 50 as created",
        "if(o_orderkey % 3 = 0, -1L, o_orderkey % 40) as last_rollout", "if(o_orderkey % 5 = 0, -1L, o_orderkey % 30) as last_sft", "o_orderkey % 4 as k_succ", "4L as k_total",
    )


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.count_if(F.col("l_quantity") > 25).alias("k_succ"), F.count(F.lit(1)).alias("k_total"))
    return lines.join(table(spark, sf_dir, "orders").selectExpr("o_orderkey as node", "concat('t', o_custkey) as tree"), "node").withColumn("step", F.lit(60).cast("long"))


@query("pool_observe", f"""WITH {P} SELECT tree, node, CASE WHEN s.k_total IS NOT NULL AND s.k_succ = s.k_total THEN FALSE WHEN s.k_total IS NOT NULL AND parent IS NULL THEN TRUE ELSE active END AS active,
  CASE WHEN s.k_total IS NOT NULL THEN 60 ELSE last_rollout END::BIGINT AS last_rollout, coalesce(s.k_succ, p.k_succ)::BIGINT AS k_succ, coalesce(s.k_total, p.k_total)::BIGINT AS k_total FROM p LEFT JOIN s USING (tree, node)""")  # fmt: skip
def pool_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.observe(_pool(spark, sf_dir), _seen(spark, sf_dir)).select("tree", "node", "active", "last_rollout", "k_succ", "k_total")


@query("pool_failures", f"WITH {P} SELECT event, tree, parent, created::BIGINT AS created FROM e")
def pool_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.failures(_seen(spark, sf_dir)).select("event", "tree", "parent", "created")


@query("pool_sample", f"""WITH {P}, t AS (SELECT tree, max(last_rollout) AS tl, min(created) AS tc FROM p GROUP BY 1), o AS (SELECT * FROM p WHERE active AND parent IS NOT NULL AND last_rollout < 45 AND (last_rollout < 0 OR 45 - last_rollout >= 2)
   QUALIFY row_number() OVER (PARTITION BY tree ORDER BY last_rollout, created, node) = 1) SELECT tree, node FROM o JOIN t USING (tree) WHERE tl < 45 ORDER BY tl, tc, tree LIMIT 200""")  # fmt: skip
def pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.sample_trees(_pool(spark, sf_dir), 200, 45, 2).select("tree", "node")


@query("pool_teacher_requests", f"""WITH {P}, t AS (SELECT tree, max(last_rollout) AS tl FROM p GROUP BY 1), o AS (SELECT e.event, e.tree, e.parent FROM e JOIN p ON p.tree = e.tree AND p.node = e.parent
   QUALIFY row_number() OVER (PARTITION BY e.tree ORDER BY p.last_rollout, e.created DESC, e.event) = 1) SELECT event, tree, parent FROM o JOIN t USING (tree) ORDER BY tl, tree LIMIT 100""")  # fmt: skip
def pool_teacher_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.teacher_requests(pools.failures(_seen(spark, sf_dir)), _pool(spark, sf_dir), 100).select("event", "tree", "parent")


@query("pool_cleanup_freeze", f"""WITH {P}, a AS (SELECT tree FROM p WHERE active UNION SELECT tree FROM e) SELECT tree, node FROM p WHERE tree IN (SELECT tree FROM a) AND parent IS NOT NULL AND created BETWEEN 10 AND 30""")
def pool_cleanup_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = pools.cleanup(_pool(spark, sf_dir), pools.failures(_seen(spark, sf_dir)))
    return pools.freeze(alive, 10, 30).select("tree", "node")


@query("pool_sample_suffixes", f"WITH {P}, o AS (SELECT * FROM p WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tree ORDER BY last_sft, created, node) <= 2) SELECT tree, node FROM o ORDER BY last_sft, created, tree, node LIMIT 300")
def pool_sample_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.sample_suffixes(_pool(spark, sf_dir), 300, 2).select("tree", "node")


@query("pool_round_robin", f"""WITH {P}, r AS (SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY created, node) AS round FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY tree) AS k, count(*) OVER (PARTITION BY round) // 64 * 64 AS f FROM r)
  SELECT tree, node, round::INT AS round, ((k - 1) // 64)::BIGINT AS batch FROM q WHERE k <= f""")  # fmt: skip
def pool_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.round_robin_batches(_pool(spark, sf_dir), 64).select("tree", "node", F.col("round").cast("int").alias("round"), F.col("batch").cast("long").alias("batch"))


_G = {"trees": "count(DISTINCT tree)", "nodes": "count(*)", "active_nodes": "count(*) FILTER (active)", "active_trees": "count(DISTINCT tree) FILTER (active)", "suffix_nodes": "count(parent)",
      "mastered": "count(*) FILTER (k_total > 0 AND k_succ = k_total)", "rollouts": "sum(k_total)", "successes": "sum(k_succ)"}


@query("pool_stats", f"WITH {P} " + " UNION ALL ".join(f"SELECT '{k}' AS key, ({v})::DOUBLE AS value FROM p" for k, v in _G.items()) + " UNION ALL SELECT 'events', count(*) FROM e UNION ALL SELECT 'in_flight', 0")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.pool_stats(_pool(spark, sf_dir), pools.failures(_seen(spark, sf_dir)))


def _forest_sql() -> str:
    """Every gauge by a scalar query of its own."""
    of = {
        "trees": "count(DISTINCT tree) FROM f", "nodes": "count(*) FROM f", "active": "count(*) FROM f WHERE active", "active_child": "count(*) FROM f WHERE active AND parent IS NOT NULL", "suffixes": "count(*) FROM f WHERE suffixed",
        "inactive": "count(*) FROM f WHERE NOT active", "sft_nodes": "count(*) FROM f WHERE active AND parent IS NOT NULL AND suffixed", "sft_trees": "count(DISTINCT tree) FROM f WHERE active AND parent IS NOT NULL AND suffixed",
        "sft_updates": "sum(sft_updates) FROM f", "ready_trees": "count(DISTINCT tree) FROM f WHERE active AND parent IS NOT NULL", "root_seen": "count(*) FROM f WHERE parent IS NULL", "child_seen": "count(*) FROM f WHERE parent IS NOT NULL",
        "root_rate": "avg((k_succ > 0)::INT) FROM f WHERE parent IS NULL", "child_rate": "avg((k_succ > 0)::INT) FROM f WHERE parent IS NOT NULL",
        "events": "count(*) FROM e", "in_flight": "0", "queued": "count(*) FROM e", **{k: f"count(*) FROM orders WHERE o_orderkey % {len(pools.LOGGED)} = {i}" for i, k in enumerate(pools.LOGGED)},
    }
    parts = [f"SELECT '{k}' AS key, round((SELECT {of[v]}), 6)::DOUBLE AS value" for k, v in pools.GAUGES.items()] + [f"SELECT '{k}', 0.0::DOUBLE" for k in pools.ZEROS]
    return f"WITH {P}, f AS (SELECT *, node % 7 <> 0 AND parent IS NOT NULL AS suffixed, node % 3 AS sft_updates FROM p) " + " UNION ALL ".join(parts)


@query("pool_forest_stats", _forest_sql())
def pool_forest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _pool(spark, sf_dir).selectExpr("*", "node % 7 <> 0 and parent is not null as suffixed", "node % 3 as sft_updates")
    kinds = F.array(*[F.lit(k) for k in pools.LOGGED])
    log = table(spark, sf_dir, "orders").select(F.get(kinds, (F.col("o_orderkey") % len(pools.LOGGED)).cast("int")).alias("kind"))
    return pools.forest_stats(nodes, pools.failures(_seen(spark, sf_dir)), log).withColumn("value", F.round("value", 6))


@query("pool_evict", "SELECT event_id FROM events WHERE 500 - event_id % 600 <= 200 ORDER BY event_id DESC LIMIT 1000")
def pool_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.evict(table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 600 as step"), 500, 200, 1000, "event_id").select("event_id")


@query("pool_last_write", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def pool_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.last_write(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "value")


@query("pool_teacher_outcomes")
def pool_teacher_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _pool(spark, sf_dir).withColumn("ids", F.array(F.coalesce("parent", "node"), F.col("node")))
    events = pools.failures(_seen(spark, sf_dir))
    kind = F.pmod(F.hash("event"), F.lit(5))
    answers = events.join(nodes.select("tree", F.col("node").alias("parent"), "ids"), ["tree", "parent"]).select(
        F.when(kind == 0, F.lit("gone")).otherwise(F.col("event")).alias("event"), F.when(kind == 1, F.array(F.lit(-1).cast("long"))).otherwise(F.concat("ids", F.array(F.lit(-5).cast("long")))).alias("prefix"),
        F.when(kind == 2, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.lit(9).cast("long"))).alias("suffix"), (kind != 3).alias("success"),
    )
    return pools.teacher_outcomes(answers, events, nodes).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("pool_chains")
def pool_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.chains_batch(chain_events(table(spark, sf_dir, "events")))


def chain_events(events: DataFrame) -> DataFrame:
    """The event table as a chain's events."""
    return events.selectExpr(
        "concat('p', user_id) as prompt", "event_id as step", "event_id as seq", "case event_id % 3 when 0 then 'failure' when 1 then 'teacher' else 'observation' end as kind",
        "cast(event_id % 5 as int) as k_succ", "4 as k_total", "cast(event_id % 100 as int) as depth", "event_id % 7 <> 0 as success",
    )


@query("windowed_metrics", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pools.windowed_metrics(table(spark, sf_dir, "events"), "ts", "1 hour", "2 hours", "value", "event_type")
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


# Datasets.


@query("dataset_canonical", "SELECT source AS data_source, lang AS ability, n_chars::VARCHAR AS ground_truth, 'train' AS split, doc_id AS index, length(text)::INT AS prompt_chars, '{}' AS tools_kwargs FROM documents")
def dataset_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = datasets.with_defaults(datasets.canonical(docs, F.col("source"), F.col("text"), F.col("lang"), F.col("n_chars"), "train", F.col("doc_id")))
    return rows.select("data_source", "ability", F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.split").alias("split"), "index", F.length(F.col("prompt")[0]["content"]).alias("prompt_chars"), "tools_kwargs")


@query("dataset_messages", "SELECT conv_id, count(*)::INT AS turns, string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def dataset_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = datasets.messages_of(table(spark, sf_dir, "conversations"))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda a, x: a + F.length(x.getField("content")))
    return m.select("conv_id", F.size("messages").alias("turns"), F.array_join("messages.role", ",").alias("roles"), chars.alias("chars"))


@query("dataset_loss_mask", "SELECT conv_id, turn, (role = 'assistant')::INT AS mask, role = 'system' AND turn > 0 AS misplaced FROM conversations")
def dataset_loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", datasets.loss_mask(F.col("role")).alias("mask"), datasets.check_system_first(F.col("turn"), F.col("role")).alias("misplaced"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation a row, from its first message that isn't a system's in the wrong place; one in three has tools, one in two doesn't think."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system' or turn = 0")
    return datasets.messages_of(turns).withColumns({"tools": F.expr("if(conv_id % 3 = 0, '[{\"name\":\"find\"}]', null)"), "thinking": F.expr("conv_id % 2 = 0")})


C = r"""c AS (SELECT conv_id, row_number() OVER w - 1 AS i, role, coalesce(text, '') AS t, CASE WHEN conv_id % 3 = 0 THEN E'\n\n# Tools\n[{"name":"find"}]' ELSE '' END AS tools, CASE WHEN conv_id % 2 = 0 THEN '' ELSE E'<think>\n\n</think>\n\n' END AS think
  FROM conversations WHERE role <> 'system' OR turn = 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  m AS (SELECT *, CASE WHEN i = 0 AND tools <> '' AND role <> 'system' THEN E'<|im_start|>system\n' || tools || E'<|im_end|>\n' ELSE '' END || '<|im_start|>' || role || E'\n' || CASE WHEN role = 'assistant' THEN think ELSE '' END AS head,
  t || CASE WHEN role = 'system' AND i = 0 THEN tools ELSE '' END || E'<|im_end|>\n' AS body FROM c)"""


@query("chat_rendered", f"WITH {C} SELECT conv_id, string_agg(head || body, '' ORDER BY i) || E'<|im_start|>assistant\n' || any_value(think) AS text FROM m GROUP BY 1")
def chat_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.pieces(F.col("messages"), None, F.col("tools"), F.col("thinking"), prompt=True)
    return _chats(spark, sf_dir).select("conv_id", chat.text_of(made).alias("text"))


@query("chat_learn_spans", f"""WITH {C}, p AS (SELECT conv_id, i, sum(length(head || body)) OVER (PARTITION BY conv_id ORDER BY i) - length(body) AS begins, length(body) AS n FROM m QUALIFY role = 'assistant')
  SELECT conv_id, begins::INT AS start, (begins + n)::INT AS "end" FROM p""")  # fmt: skip
def chat_learn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the assistant's part of each conversation lies in its text, in characters."""
    made = chat.spans_of(chat.pieces(F.col("messages"), None, F.col("tools"), F.col("thinking")))
    return _chats(spark, sf_dir).select("conv_id", F.explode(F.filter(made, lambda s: s["learn"])).alias("s")).select("conv_id", "s.start", "s.end")


@query("chat_token_masks")
def chat_token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, masks, attention and positions of 512 tokens a conversation; longer ones lose their beginning. Tests hold it against re-encoded prefixes."""
    import public_tokenizers

    out = chat.sft_rows(_chats(spark, sf_dir), "messages", public_tokenizers.path("byte_bpe_50k.json"), 512, "left", tools="tools", thinking="thinking")
    return out.select("conv_id", "ids", "learn", "attention", "positions", "n_tokens", "fault")


@query("chat_prompts")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all but an assistant's last message, padded on the left to 256 tokens, those that are longer cut in the middle."""
    import public_tokenizers

    last = F.element_at("messages", -1)["role"] == "assistant"
    rows = _chats(spark, sf_dir).withColumn("messages", F.when(last, F.slice("messages", 1, F.size("messages") - 1)).otherwise(F.col("messages")))
    out = chat.prompt_rows(rows, "messages", public_tokenizers.path("byte_bpe_50k.json"), 256, "middle")
    return out.select("conv_id", "ids", "raw_ids", "attention", "positions")


@query("dataset_role_blocks", "WITH n AS (SELECT *, (role IS DISTINCT FROM lag(role) OVER w)::INT AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM n")
def dataset_role_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.tool_groups(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "block")


@query("dataset_preferences", """WITH x AS (SELECT d.lang AS prompt, d.doc_id, d.doc_id || ':' || d.source AS response, l.quality = 1 AS good FROM documents d JOIN labels l USING (doc_id))
  SELECT prompt, arg_min(response, doc_id) FILTER (good) AS chosen, arg_min(response, doc_id) FILTER (NOT good) AS rejected FROM x GROUP BY 1 HAVING bool_or(good) AND NOT bool_and(good)""")  # fmt: skip
def dataset_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("lang as prompt", "doc_id", "concat(doc_id, ':', source) as response", "quality")
    return datasets.preference_pairs(rows, "prompt", "response", F.col("quality") == 1, "doc_id")


@query("dataset_split", "SELECT doc_id, CASE WHEN ('0x' || substr(md5('1:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents WHERE length(trim(text)) > 0")
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.hash_split(table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0).select("doc_id"), "doc_id", 0.1, 1)


@query("dataset_length_filter", "SELECT user_id AS seq, count(*)::INT AS n FROM events GROUP BY 1 HAVING count(*) <= 70")
def dataset_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, "token").select("seq", F.size("token").alias("n")).where("n <= 70")


@query("dataset_generate", "SELECT c_custkey AS key, c_name || '#0|' || c_name || '#1' AS responses FROM customer")
def dataset_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as prompt")
    return datasets.generate(rows, "key", "prompt", 2, lambda texts, i: [f"{t}#{i}" for t in texts]).select("key", F.array_join("responses", "|").alias("responses"))


@query("dataset_flatten", "SELECT doc_id AS \"id\", lang AS \"meta/lang\", n_chars AS \"meta/size/n\" FROM documents")
def dataset_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.struct("lang", F.struct(F.col("n_chars").alias("n")).alias("size")).alias("meta"))
    return rows.select(*datasets.flat_columns(rows.schema))


@query("pool_chain_sample", f"""WITH u AS (SELECT o_orderkey::VARCHAR AS prompt, o_orderkey % 4 AS k, o_orderkey % 5 AS n FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <= o_orderkey % 5),
  w AS (SELECT prompt, CASE WHEN n = 0 THEN 1.0 ELSE 4 * (k / n) * (1 - k / n) END AS w, (('0x' || substr(md5('8:' || prompt), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM u)
  SELECT prompt FROM w ORDER BY CASE WHEN w > 0 THEN ln(u) / w ELSE '-inf'::DOUBLE END DESC, prompt LIMIT 200""")  # fmt: skip
def pool_chain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning chains drawn by how uncertain their active node is."""
    chains = table(spark, sf_dir, "orders").where("o_orderkey % 4 <= o_orderkey % 5").selectExpr("cast(o_orderkey as string) as prompt", "if(o_orderkey % 3 = 0, 'completed', 'learning') as state", "o_orderkey % 4 as k_succ", "o_orderkey % 5 as k_total")
    return pools.sample_chains(chains, 200, 8).select("prompt")
