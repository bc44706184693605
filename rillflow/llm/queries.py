"""The queries ``opN_<name>`` over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import collocations, hard_negatives, odd_sketches, packing, page_text, quality_rules, secret_scan, sentence_pieces, substring_dedup, suffix_dedup, tool_links, tree_forest, url_filter

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"), keep_text=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


TOOLS = {
    "search": {"query": tool_links.Field("string", least=3), "n_words": tool_links.Field("integer", least=1)},
    "answer": {"query": tool_links.Field("string", least=20), "n_words": tool_links.Field("integer", least=13)},
}


def op4_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_links.link(*tool_links.turns_as_tools(_table(spark, sf_dir, "conversations")), TOOLS)


def op5_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketches.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("row")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_tool_links": op4_tool_links,
    "op5_tree_forest": op5_tree_forest,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_odd_sketches": op8_odd_sketches,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_collocations": op11_collocations,
    "op12_page_text": op12_page_text,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op4_tool_links": r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS q, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, 'call:' || conv_id || ':' || turn AS call_id, CASE WHEN n <= 12 THEN 'search' ELSE 'answer' END AS name, q, n FROM u),
lv AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, lv.level + 1 FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
j AS (SELECT c.*, lv.level, a.turn AS result_turn, a.text AS result, concat_ws(', ',
    CASE WHEN name = 'search' AND length(q) < 3 THEN 'query: below 3' WHEN name = 'answer' AND length(q) < 20 THEN 'query: below 20' END,
    CASE WHEN name = 'search' AND n < 1 THEN 'n_words: below 1' END) AS errors
  FROM c JOIN lv USING (conv_id, turn) LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1)
SELECT conv_id, turn, call_id, name, level, result_turn, errors, errors = '' AS valid,
  '{"arguments":{"n_words":' || n || ',"query":' || to_json(q) || '},"call_id":"' || call_id || '","name":"' || name || '","needs":["call:' || conv_id || ':' || (turn - 2) || '"],'
  || coalesce('"result":' || to_json(result) || ',', '') || '"valid":' || (errors = '') || '}' AS json FROM j""",
    "op3_quality_rules": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
named AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM named WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, body, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
d AS (SELECT c.*, coalesce(n_rep, 0) AS n_repeat_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM c LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 2 * n_dup_lines > len(ls) OR 100 * len(regexp_extract_all(body, '!!')) > 30 * n_words OR 100 * len(regexp_extract_all(body, '[A-Z]')) > 60 * word_chars) AS kept
FROM d""",
    "op5_tree_forest": r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.w FROM r JOIN l ON r.reach = l.u),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id), n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op8_odd_sketches": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.reach = l.u),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op10_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w),
i AS (SELECT doc_id, place, list(word) OVER v AS run FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
d AS (SELECT doc_id, place FROM i WHERE len(run) = 20 QUALIFY row_number() OVER (PARTITION BY array_to_string(run, ' ') ORDER BY doc_id, place) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(place, place + 20)) AS place FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, place) GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op7_url_filter": r"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS u FROM pages),
q AS (SELECT page_id, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path FROM p),
rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT q.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS ruled
  FROM q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.page_id),
j AS (SELECT q.page_id, q.host, q.path, fits.rule, fits.ruled,
  regexp_replace(regexp_replace(q.host, '(:\d*|\.)$', ''), '^(www|m)\.', '') || regexp_replace(regexp_replace(q.path, '/{2,}', '/', 'g'), '(\.html?|/)$', '') AS canonical
  FROM q LEFT JOIN fits USING (page_id))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN canonical IN (SELECT canonical FROM j WHERE ruled = 'block') THEN 'block' ELSE 'allow' END) AS verdict FROM j""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest(range(1, least(4, len(ws) - i + 1) + 1)) AS d FROM i),
f AS (SELECT lang, ws[i : i + d - 1] AS path, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, path, f AS a FROM f WHERE len(path) > 1),
k AS (SELECT *, unnest(range(1, len(path))) AS k FROM c),
s AS (SELECT k.lang, k.path, k.k, k.a, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a) // (x.f + y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.path = k.path[1 : k.k] JOIN f y ON y.lang = k.lang AND y.path = k.path[k.k + 1 :]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1),
b AS (SELECT lang, path, a, unnest(range(1, len(path) + 1)) AS i FROM c),
e AS (SELECT lang, path, a, i, unnest(range(2, len(path) - i + 2)) AS d FROM b),
inside AS (SELECT lang, path[i : i + d - 1] AS path, max(a) AS over FROM e WHERE d < len(path) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, path) WHERE over IS NULL OR 100 * over::HUGEINT < 80 * a::HUGEINT),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(path, ' ')) AS rank, array_to_string(path, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_page_text": r"""
WITH a AS (SELECT page_id, url, unnest(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>')) AS block, generate_subscripts(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), 1) AS i FROM pages),
d AS (SELECT page_id, url, i, replace(replace(replace(replace(regexp_replace(block, '<br>|\s', ' ', 'g'), '<b>', ''), '</b>', ''), '&#39;', chr(39)), '&quot;', '"') AS t FROM a),
e AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), ' +', ' ', 'g')) AS t FROM d)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> ''), '') AS text, coalesce(length(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE t <> '')), 0)::BIGINT AS n_chars FROM e GROUP BY page_id, url""",
    "op13_hard_negatives": r"""
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.vec_id = b.vec_id AS own, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND NOT own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
}
