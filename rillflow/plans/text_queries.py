"""Queries: answers extracted and graded. The driver's texts hold no markers, so each query writes its own by expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import algebra
from rillflow.functions import grading as g
from rillflow.functions import mathtext as mt
from rillflow.plans.catalog import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.regexp_replace("text", "[#<>$@]", "").alias("text"))


D = "d AS (SELECT doc_id, lang, source, n_chars, regexp_replace(text, '[#<>$@]', '', 'g') AS text FROM documents)"
_num = "format('{:,}', n_chars)"


def _n() -> Column:
    return F.format_number("n_chars", 0)


#: Replies by ``doc_id`` modulo their number, with ``N`` for ``n_chars`` with thousands separators.
_HASHED = ("no answer", "so #### $N.", "#### 1 then #### -N", "N. and .", "#### none, 7")


def _by_id(replies: tuple[str, ...], n: Column) -> Column:
    return F.coalesce(*[F.when(F.col("doc_id") % len(replies) == i, F.replace(F.lit(r), F.lit("N"), n)) for i, r in enumerate(replies)])


def _by_id_sql(replies: tuple[str, ...], n: str) -> str:
    return f"CASE doc_id % {len(replies)} " + " ".join(f"WHEN {i} THEN replace('{r}', 'N', {n})" for i, r in enumerate(replies)) + " END"


_LOOSE = "regexp_extract_all({0}, '-?[0-9.,]+')"


@query("grade_hash_answer", rf"""WITH {D}, e AS (SELECT doc_id, {_by_id_sql(_HASHED, _num)} AS t FROM d)
  SELECT doc_id, regexp_replace(regexp_extract_all(t, '####\s*(-?[0-9.,$]+)', 1)[-1], '[,$]', '', 'g') AS strict,
    coalesce([x FOR x IN {_LOOSE.format('t')} IF x <> '.'][-1], {_LOOSE.format('t')}[1]) AS loose FROM e""")  # fmt: skip
def grade_hash_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _by_id(_HASHED, _n())
    return _docs(spark, sf_dir).select("doc_id", g.strict_number(t).alias("strict"), g.loose_number(t).alias("loose"))


#: Replies with ``N`` for the truth, ``n_chars``.
_NUMBERS = ("none", "#### 1 #### N", "#### N", "#### 0", "first 12, then N", "\\boxed{N} \\boxed{N}")


@query("grade_number_reward", rf"""WITH {D}, e AS (SELECT doc_id, n_chars::VARCHAR AS truth, '#### 5<|im_end|><|im_start|>assistant ' || {_by_id_sql(_NUMBERS, 'n_chars::VARCHAR')} || '<|im_end|> 77' AS t FROM d),
  r AS (SELECT *, string_split(string_split(t, '<|im_start|>assistant')[-1], '<|im_end|>')[1] AS r FROM e),
  a AS (SELECT *, coalesce([x FOR x IN {_LOOSE.format('r')} IF x <> '.'][-1], {_LOOSE.format('r')}[1]) AS a, len(regexp_extract_all(r, '####\s*(-?[0-9.,$]+)')) > 1 OR len(regexp_extract_all(r, '\\boxed')) > 1 AS bad FROM r)
  SELECT doc_id, (a IS NOT NULL AND NOT bad AND a = truth)::INT::DOUBLE AS reward, (a IS NOT NULL AND NOT bad)::INT AS completed FROM a""")  # fmt: skip
def grade_number_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    t = F.concat(F.lit("<|im_start|>user\n#### 5<|im_end|>\n<|im_start|>assistant\n"), _by_id(_NUMBERS, n), F.lit("<|im_end|> 77"))
    s = g.number_score(t, n)
    return _docs(spark, sf_dir).select("doc_id", s.reward.alias("reward"), s.completed.alias("completed"))


@query("grade_plain_answer", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\t\n -~]', 'x', 'g')), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS answer FROM documents""")
def grade_plain_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", g.plain_answer(F.regexp_replace("text", r"[^\t\n -~]", "x")).alias("answer"))


def _plain_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


_ANSWERED = "trim(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1)[-1])"


@query("grade_tag_answer", rf"""WITH g AS (SELECT doc_id, source, '<answer>The ' || source || '!</answer>' AS good FROM documents),
  t AS (SELECT doc_id, ['other', upper(source)] AS golds, CASE doc_id % 4 WHEN 0 THEN 'nothing' WHEN 1 THEN good WHEN 2 THEN '<answer>no</answer>' ELSE repeat('<answer>x</answer>', 10) || good END AS t FROM g),
  a AS (SELECT doc_id, golds, {_ANSWERED} AS a, CASE WHEN len(regexp_extract_all(t, '<answer>')) > 10 THEN 0.25 ELSE 1.0 END AS best FROM t)
  SELECT doc_id, CASE WHEN a IS NULL THEN 0 WHEN len([x FOR x IN golds IF {_plain_sql('x')} = {_plain_sql('a')}]) > 0 THEN best ELSE 0.1 END::DOUBLE AS score,
    CASE WHEN a IS NULL THEN 0 WHEN len([x FOR x IN golds IF contains({_plain_sql('a')}, {_plain_sql('x')})]) > 0 THEN best ELSE 0.1 END::DOUBLE AS sub FROM a""")  # fmt: skip
def grade_tag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    good = F.concat(F.lit("<answer>The "), F.col("source"), F.lit("!</answer>"))
    t = F.when(kind == 0, "nothing").when(kind == 1, good).when(kind == 2, "<answer>no</answer>").otherwise(F.concat(F.repeat(F.lit("<answer>x</answer>"), 10), good))
    golds = F.array(F.lit("other"), F.upper("source"))
    return table(spark, sf_dir, "documents").select("doc_id", g.tag_score(t, golds, format_score=0.1).alias("score"), g.tag_score(t, golds, g.sub_match, format_score=0.1).alias("sub"))


#: Replies about tables by ``doc_id`` modulo their number, ``N`` for the source.
_TABLE_REPLIES = (
    "<Answer>The N!</Answer>", "<Answer>first\nAnswer: N </Answer>", "Answer: other\nAnswer: N\nbye", "\n nothing here\n N. ", "", "<Analyze>I look. The answer is: \"N\".</Analyze>", "<Analyze>hm</Analyze>\n The answer is ''N''\nmore",
    "<Analyze>Therefore, the N. Or not</Analyze>", "<Analyze>nothing</Analyze> ", "I think THE ANSWER  IS N. Surely", "<Answer></Answer>", "<Analyze>so  x</Analyze><Answer>N</Answer>", "<Answer>y</Answer> <Answer>N</Answer>", "Answer:\n\nN\nx",
)


def _table_reply_sql(by_line: bool) -> str:
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    first = lambda x, p: f"regexp_extract_all({x}, '{p}', 1)[1]"
    said = r"(?i)(?:the\s+answer\s+is\s*:?\s*)([^\n]*?)(?:$|\.|\n)"
    ended = r"(?i)(?:therefore|thus|so|hence|consequently|in conclusion)[,:]?\s+([^\n]*?)(?:$|\.|\n)"
    marked = r"regexp_extract_all(t, 'Answer:\s*([^\n]*)', 1)[-1]" if by_line else "string_split(t, 'Answer:')[-1]"
    rest = rf"string_split({strip('t')}, chr(10))[-1]" if by_line else "t"
    return rf"""b AS (SELECT *, {strip(first('t', '(?s)<Answer>(.*?)</Answer>'))} AS b FROM t),
  r AS (SELECT *, regexp_replace({strip(f"CASE WHEN b IS NOT NULL THEN string_split(b, 'Answer:')[-1] WHEN contains(t, 'Answer:') THEN {marked} ELSE {rest} END")}, '</?Answer>', '', 'g') AS r FROM b),
  h AS (SELECT *, {first('r', '(?s)<Analyze>(.*?)</Analyze>')} AS h, {strip(first('r', r'(?s)<Analyze>.*?</Analyze>\s*(.*)'))} AS f FROM r),
  k AS (SELECT *, CASE WHEN f = '' THEN coalesce(regexp_replace({strip(first('h', said))}, '^["''](.*?)["'']\.?$', '\1'), {strip(first('h', ended))}) END AS k, CASE WHEN f <> '' THEN f ELSE r END AS g FROM h),
  a AS (SELECT *, coalesce(k, regexp_replace({strip(first('g', said))}, '^["''](.*)["'']$', '\1'), {strip('g')}) AS answer FROM k)"""


def _table_reply_query(by_line: bool) -> str:
    return rf"""WITH t AS (SELECT doc_id, source, {_by_id_sql(tuple(r.replace(chr(10), "' || chr(10) || '") for r in _TABLE_REPLIES), "source")} AS t FROM documents), {_table_reply_sql(by_line)}
  SELECT doc_id, answer, CASE WHEN answer <> '' AND {_plain_sql('answer')} = {_plain_sql('source')} THEN 1 ELSE 0 END::DOUBLE AS reward, (answer <> '')::INT AS completed FROM a"""


def _table_replies(spark: SparkSession, sf_dir: str, by_line: bool) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", _by_id(tuple(r.replace("''", "'") for r in _TABLE_REPLIES), F.col("source")).alias("t"))
    return rows.select("doc_id", g.table_reply_answer(F.col("t"), by_line).alias("answer"), g.table_reply_score(F.col("t"), F.col("source"), by_line).alias("s")).select("doc_id", "answer", "s.*")


@query("grade_table_reply", _table_reply_query(False))
def grade_table_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_replies(spark, sf_dir, False)


@query("grade_table_reply_lines", _table_reply_query(True))
def grade_table_reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_replies(spark, sf_dir, True)


_TAGS_EVEN = " AND ".join(f"len(regexp_extract_all(t, '<{k}>')) = len(regexp_extract_all(t, '</{k}>'))" for k in ("think", "search", "information", "answer"))
_TAGS_ORDER = r"\s*<think>[^<]*</think>\s*(<search>[^<]*</search>\s*<information>[^<]*</information>\s*<think>[^<]*</think>\s*)*<answer>[^<]*</answer>\s*"


@query("grade_tag_states", rf"""WITH g AS (SELECT doc_id, source, '<answer>' || source || '</answer>' AS a FROM documents),
  t AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN E'<think>a</think>\n' || a WHEN 1 THEN '<think>a</think><search>q</search><information>the ' || source || ' is</information><think>b</think>' || a
    WHEN 2 THEN '<search>q</search><think>a</think>' || a WHEN 3 THEN '<think>a</think><answer>' ELSE '<think>a' END AS t FROM g),
  j AS (SELECT doc_id, {_ANSWERED} AS a, regexp_full_match(t, '{_TAGS_ORDER}') AS strict, {_TAGS_EVEN} AND regexp_extract_all(t, '</?(?:think|search|information|answer)>')[-1] = '</answer>' AS loose,
    len([x FOR x IN regexp_extract_all(t, '(?s)<information>(.*?)</information>', 1) IF contains({_plain_sql('x')}, {_plain_sql('source')})]) > 0 AS retrieved, source FROM t)
  SELECT doc_id, strict, loose, retrieved, round(CASE WHEN a IS NOT NULL AND {_plain_sql('a')} = {_plain_sql('source')} THEN CASE WHEN strict THEN 1.0 ELSE 0.8 END
    WHEN strict THEN CASE WHEN retrieved THEN 0.3 ELSE 0.2 END WHEN a IS NOT NULL THEN 0.1 ELSE 0.0 END::DOUBLE, 6) AS reward FROM j""")  # fmt: skip
def grade_tag_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, s = F.col("doc_id") % 5, F.col("source")
    answer = F.concat(F.lit("<answer>"), s, F.lit("</answer>"))
    t = (
        F.when(kind == 0, F.concat(F.lit("<think>a</think>\n"), answer)).when(kind == 1, F.concat(F.lit("<think>a</think><search>q</search><information>the "), s, F.lit(" is</information><think>b</think>"), answer))
        .when(kind == 2, F.concat(F.lit("<search>q</search><think>a</think>"), answer)).when(kind == 3, "<think>a</think><answer>").otherwise("<think>a")
    )
    answered, golds = g.tag_answer(t).isNotNull(), F.array(s)
    matched = answered & g.exact_match(F.coalesce(g.tag_answer(t), F.lit("")), golds)
    reward = g.format_matrix(answered, matched, g.valid_sequence(t), g.retrieval_correct(t, golds))
    return table(spark, sf_dir, "documents").select("doc_id", g.valid_sequence(t).alias("strict"), g.valid_sequence(t, loose=True).alias("loose"), g.retrieval_correct(t, golds).alias("retrieved"), F.round(reward, 6).alias("reward"))


#: Answers by ``doc_id % 13`` beside the number ``doc_id + 100``: (answer, truth), with ``N`` for the number.
_FINANCE = (
    ("N", "N"), ("N%", "0.N"), ("$N million", "N000000"), ("N.004", "N"), ("none", "N"), ("Yes ", "yes"), ("no", "yes"), (".5", "0.5"), ("N.24%", "N.3%"), ("N.4%", "N.6%"),
    ("$1.04 billion", "1 billion"), ("about -N.9", "-N"), ("N percent", "N%"),
)


def _finance_sql(side: int) -> str:
    return "CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN replace('{p[side]}', 'N', (doc_id + 100)::VARCHAR)" for i, p in enumerate(_FINANCE)) + " END"


@query("grade_finance", rf"""WITH p AS (SELECT doc_id, {_finance_sql(0)} AS a, {_finance_sql(1)} AS t FROM documents),
  n AS (SELECT *, TRY_CAST(nullif(regexp_extract(a, '[-+]?[0-9]*\.?[0-9]+'), '') AS DOUBLE) AS x, TRY_CAST(nullif(regexp_extract(t, '[-+]?[0-9]*\.?[0-9]+'), '') AS DOUBLE) AS y, contains(a, '%') AS ap, contains(t, '%') AS tp FROM p)
  SELECT doc_id, CASE WHEN x IS NULL OR y IS NULL THEN lower(trim(a)) = lower(trim(t)) WHEN abs(x - y) < 0.01 THEN TRUE WHEN ap <> tp THEN FALSE WHEN ap THEN abs(round(x, 1) - round(y, 1)) < 0.15
    ELSE abs(x - y) / greatest(abs(y), 1) < 0.05 END AS correct FROM n""")  # fmt: skip
def grade_finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("doc_id") % 13, (F.col("doc_id") + 100).cast("string")
    pick = lambda side: F.coalesce(*[F.when(kind == i, F.replace(F.lit(p[side]), F.lit("N"), n)) for i, p in enumerate(_FINANCE)])
    return table(spark, sf_dir, "documents").select("doc_id", g.finance_match(pick(0), pick(1)).alias("correct"))


@query("grade_numeric_equal", "SELECT event_id, abs(value - value * (1 + (event_id % 5) / 20000.0::DOUBLE)) <= 1e-4 * greatest(abs(value), abs(value * (1 + (event_id % 5) / 20000.0::DOUBLE))) AS same FROM events")
def grade_numeric_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", g.numeric_equal(v, v * (1 + (F.col("event_id") % 5) / 20000.0)).alias("same"))


def _named_sql(name: str) -> str:
    return f"[v[i] FOR i IN range(1, len(k) + 1) IF k[i] = '{name}'][-1]"


@query("grade_named_values", rf"""WITH t AS (SELECT doc_id, lang, n_chars, '@lang[' || lang || '] ' || CASE doc_id % 3 WHEN 0 THEN '@n[0] @n[' || n_chars || '.0000001]' WHEN 1 THEN '@n[-1]' ELSE '' END AS t FROM documents),
  p AS (SELECT *, regexp_extract_all(t, '@(\w+)\[(.*?)\]', 1) AS k, regexp_extract_all(t, '@(\w+)\[(.*?)\]', 2) AS v FROM t), n AS (SELECT *, {_named_sql('lang')} AS l, {_named_sql('n')} AS n FROM p)
  SELECT doc_id, coalesce(l = lang AND abs(n::DOUBLE - n_chars) <= 1e-6, FALSE)::INT::DOUBLE AS reward, (l IS NOT NULL AND n IS NOT NULL)::INT AS completed FROM n""")  # fmt: skip
def grade_named_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    t = F.concat(F.lit("@lang["), F.col("lang"), F.lit("] "), F.when(kind == 0, F.concat(F.lit("@n[0] @n["), n, F.lit(".0000001]"))).when(kind == 1, "@n[-1]").otherwise(""))
    s = g.named_score(t, F.create_map(F.lit("lang"), F.col("lang"), F.lit("n"), n))
    return table(spark, sf_dir, "documents").select("doc_id", s.reward.alias("reward"), s.completed.alias("completed"))


_TRACE = "CASE WHEN doc_id % 2 = 0 THEN E'<Code>```python\\nx\\n```</Code>' ELSE '<Code>x</Code>' END || repeat('<Execute>fine</Execute>', (doc_id % 4)::INT) || repeat('<Execute>[Error]: bad</Execute>', (4 - doc_id % 4)::INT)"


@query("grade_code_traces", rf"""WITH t AS (SELECT doc_id, {_TRACE} AS t FROM documents), e AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)<Execute>(.*?)</Execute>', 1) AS runs, regexp_extract_all(t, '(?s)<Code>(.*?)</Code>', 1) AS codes FROM t)
  SELECT doc_id, round(len([x FOR x IN runs IF NOT contains(x, '[Error]:')]) / len(runs)::DOUBLE, 6) AS passed, len([x FOR x IN codes IF NOT regexp_matches(x, '(?s)^\s*```python\n.*```\s*$')]) = 0 AS fenced,
    contains(t, '<Code>') AND contains(t, '</Code>') AND contains(t, '<Execute>') AND contains(t, '</Execute>') AS tagged, regexp_extract_all(t || ' SCORE: 1 SCORE: 3', 'SCORE:\s*(\d+)', 1)[-1]::INT / 4.0::DOUBLE AS quality FROM e""")  # fmt: skip
def grade_code_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_traces(table(spark, sf_dir, "documents"))


def _code_traces(rows: DataFrame) -> DataFrame:
    k = (F.col("doc_id") % 4).cast("int")
    code = F.when(F.col("doc_id") % 2 == 0, "<Code>```python\nx\n```</Code>").otherwise("<Code>x</Code>")
    t = F.concat(code, F.repeat(F.lit("<Execute>fine</Execute>"), k), F.repeat(F.lit("<Execute>[Error]: bad</Execute>"), 4 - k))
    return rows.select("doc_id", F.round(g.execute_pass_ratio(t), 6).alias("passed"), g.code_blocks_fenced(t).alias("fenced"), g.has_tags(t, "Code", "Execute").alias("tagged"), g.judged(F.concat(t, F.lit(" SCORE: 1 SCORE: 3")), "SCORE", 4).alias("quality"))


@query("grade_overlong", "SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / 1000.0::DOUBLE * 0.5::DOUBLE, 0), 6) AS penalty FROM documents")
def grade_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(g.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5), 6).alias("penalty"))


@query("grade_by_source", "SELECT source, count(*) AS n, round(avg(CASE WHEN source < 'src3' THEN (n_chars % 2)::DOUBLE ELSE (n_chars > 1000)::INT::DOUBLE END), 6) AS score FROM documents GROUP BY 1")
def grade_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("source") < "src3", (F.col("n_chars") % 2).cast("double")).when(F.col("source").startswith("src"), (F.col("n_chars") > 1000).cast("double")).otherwise(F.raise_error(F.lit("unknown source")).cast("double"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("score"))


@query("text_segments", r"""WITH t AS (SELECT doc_id, 'a <code> print(1) </code> b <interpreter>1</interpreter><answer>' || doc_id || '</answer>' AS t FROM documents),
  w AS (SELECT doc_id, regexp_extract_all(t, '(?s)<code>.*?</code>|<interpreter>.*?</interpreter>|<answer>.*?</answer>') AS w FROM t), e AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w FROM w)
  SELECT doc_id, i::INT AS i, regexp_extract(w, '^<(\w+)>', 1) AS kind, trim(regexp_extract(w, '(?s)^<\w+>(.*)</\w+>$', 1)) AS body FROM e""")  # fmt: skip
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("a <code> print(1) </code> b <interpreter>1</interpreter><answer>"), F.col("doc_id").cast("string"), F.lit("</answer>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(g.segments(t)).alias("i", "s")).select("doc_id", "i", "s.*")


@query("text_media_parts", """WITH w AS (SELECT doc_id, regexp_extract_all(lang || '<image> then<video>', '<image>|<video>|[^<]+') AS w FROM documents), e AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w FROM w)
  SELECT doc_id, i::INT AS i, CASE w WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video' ELSE 'text' END AS type, CASE WHEN w NOT IN ('<image>', '<video>') THEN w END AS text FROM e""")  # fmt: skip
def text_media_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("lang", F.lit("<image> then<video>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(g.media_parts(t)).alias("i", "s")).select("doc_id", "i", "s.type", "s.text")


@query("text_passages", """SELECT doc_id, 'Doc 1 (Title: ' || lang || E')\\nx y\\nDoc 2 (Title: ' || source || E')\\n' AS passages, lang || ' | ' || source || E'\\n1 | 2\\n3 | 4' AS table_text FROM documents""".replace("\\\\", "\\"))
def text_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.concat("lang", F.lit("\nx y")), F.col("source"))
    rows = F.expr("array(array('1', '2'), array('3', '4'))")
    return table(spark, sf_dir, "documents").select("doc_id", g.passages(items).alias("passages"), g.table_text(F.array("lang", "source"), rows).alias("table_text"))


@query("text_cleanup", r"""SELECT doc_id, replace(regexp_replace(replace(trim('  ' || lang || ' [title]' || source || ' [step] b '), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS text FROM documents""")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("  "), F.col("lang"), F.lit(" [title]"), F.col("source"), F.lit(" [step] b "))
    return table(spark, sf_dir, "documents").select("doc_id", g.cleaned(t).alias("text"))


@query("text_tool_calls", r"""WITH t AS (SELECT doc_id, E'x <tool_call>\n{"name": "find", "arguments": {"n": ' || n_chars || E'}}\n</tool_call> <tool_call>oops</tool_call>' AS t FROM documents),
  b AS (SELECT doc_id, [x FOR x IN regexp_extract_all(t, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) IF json_valid(x)] AS b FROM t), e AS (SELECT doc_id, unnest(range(len(b))) AS i, unnest(b) AS b FROM b)
  SELECT doc_id, i::INT AS i, json_extract_string(b, '$.name') AS name, json_extract_string(b, '$.arguments') AS arguments FROM e""")  # fmt: skip
def text_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit('x <tool_call>\n{"name": "find", "arguments": {"n": '), F.col("n_chars").cast("string"), F.lit("}}\n</tool_call> <tool_call>oops</tool_call>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(g.tool_calls(t)).alias("i", "c")).select("doc_id", "i", "c.*")


@query("math_boxed", r"""WITH t AS (SELECT doc_id, n_chars, 'so \boxed{1} or \boxed{\frac{' || n_chars || '}{2}} .' AS t FROM documents),
  a AS (SELECT doc_id, regexp_extract_all(t, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)[-1] AS answer, n_chars / CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS truth FROM t),
  v AS (SELECT *, regexp_extract(answer, '\{(\d+)\}\{', 1)::DOUBLE / regexp_extract(answer, '\}\{(\d+)\}', 1)::DOUBLE AS v FROM a)
  SELECT doc_id, answer, abs(v - truth) <= 1e-4 * greatest(abs(v), abs(truth)) AS correct FROM v""")  # fmt: skip
def math_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    t = F.concat(F.lit("so \\boxed{1} or \\boxed{\\frac{"), n, F.lit("}{2}} ."))
    truth = F.when(F.col("doc_id") % 2 == 0, F.concat(n, F.lit("/2"))).otherwise(F.concat(n, F.lit("/3")))
    rows = table(spark, sf_dir, "documents").select("doc_id", mt.boxed_answer(t).alias("answer"), truth.alias("truth"))
    return rows.select("doc_id", "answer", mt.math_equal("answer", "truth").alias("correct"))


#: Answers and truths by ``doc_id`` modulo their number, ``N`` for ``doc_id + 100``; and the same in SQL, of ``x`` and ``n``.
_GRADED = (
    ("(x+N)^2", "x^2+2*N*x+N^2", "(x + n) * (x + n)", "x * x + 2 * n * x + n * n"), ("(x+N)^2", "x^2+N^2", "(x + n) * (x + n)", "x * x + n * n"), ("0.5", "\\frac{1}{2}", "0.5", "1 / 2"),
    ("N,000", "N000 meters", "n * 1000", "n * 1000"), ("\\frac{N}{x+7}", "N/(7+x)", "n / (x + 7)", "n / (7 + x)"), ("\\sqrt{N^2*x^2}", "N*x", "sqrt(n * n * x * x)", "n * x"),
    ("x(x-N)", "x^2 - N x", "x * (x - n)", "x * x - n * x"), ("N 1/2", "N+0.5", "n + 0.5", "n + 0.5"), ("\\frac{N}{\\sqrt{N}+3}", "\\frac{N\\sqrt{N}-3*N}{N-9}", "n / (sqrt(n) + 3)", "(n * sqrt(n) - 3 * n) / (n - 9)"),
    ("\\sqrt{N}+\\sqrt{2}", "\\sqrt{N+2}", "sqrt(n) + sqrt(2)", "sqrt(n + 2)"), ("x+y+N z", "N z+y+x", "x + 3 * x + n * x", "n * x + 3 * x + x"), ("2^{N}x", "4^{N/2}x", "2 * x", "2 * x"),
)
#: The same, where a way of writing decides: what is right only if that doesn't count.
_LENIENT = (*_GRADED, ("\\frac{N}{2*N}", "\\frac{1}{2}", "n / (2 * n)", "1 / 2"), ("\\frac{6*N}{2}", "3*N", "6 * n / 2", "3 * n"), ("\\frac{30}{3}", "10", "30 / 3", "10"), ("2^{3}N", "8*N+1", "8 * n", "8 * n + 1"))


def _graded_sql(cases: tuple, n_of: str = "doc_id") -> str:
    """Whether given and truth have the same values at two points."""
    same = lambda c, x: f"abs(({c[2]}) - ({c[3]})) <= 1e-9 * greatest(1, abs({c[2]}))".replace("x", x).replace(f"ma{x}", "max")
    return f"CASE {n_of} % {len(cases)} " + " ".join(f"WHEN {i} THEN " + " AND ".join(same(c, x) for x in ("p", "q")) for i, c in enumerate(cases)) + " END"


_POINTS_SQL = "d AS (SELECT doc_id, (doc_id + 100)::DOUBLE AS n, 2.0::DOUBLE AS p, (-3.0)::DOUBLE AS q FROM documents)"


def _answers(cases: tuple) -> tuple[Column, Column]:
    n = (F.col("doc_id") + 100).cast("string")
    return _by_id(tuple(c[0] for c in cases), n), _by_id(tuple(c[1] for c in cases), n)


@query("math_graded", f"WITH {_POINTS_SQL} SELECT doc_id, {_graded_sql(_GRADED)} AS correct FROM d")
def math_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", algebra.math_graded(*_answers(_GRADED)).alias("correct"))


@query("math_graded_lenient", f"WITH {_POINTS_SQL} SELECT doc_id, {_graded_sql(_LENIENT)} AS correct FROM d")
def math_graded_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", algebra.math_graded_lenient(*_answers(_LENIENT)).alias("correct"))


@query("grade_boxed_any", f"""WITH {_POINTS_SQL}, r AS (SELECT doc_id, doc_id % 7 <> 3 AS formatted, doc_id % 5 = 1 AS among, {_graded_sql(_LENIENT)} AS same FROM d)
  SELECT doc_id, formatted, formatted AND (same OR among) AS correct FROM r""")  # fmt: skip
def grade_boxed_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that box their answer, but for one in seven, against several truths; one in five has the answer itself among them."""
    given, truth = _answers(_LENIENT)
    reply = F.concat(F.lit("first \\boxed{1}, then "), F.when(F.col("doc_id") % 7 == 3, F.lit("no box\\boxed")).otherwise(F.concat(F.lit("\\boxed{"), given, F.lit("}."))))
    golds = F.array(F.lit("monday"), F.concat(F.lit("so \\boxed{"), truth, F.lit("}")), F.lit(None), F.when(F.col("doc_id") % 5 == 1, given))
    return table(spark, sf_dir, "documents").select("doc_id", algebra.graded_box(reply, golds).alias("g")).select("doc_id", "g.*")


@query("grade_think_answer", f"""WITH {_POINTS_SQL}, r AS (SELECT doc_id, doc_id % 4 <> 1 AS formatted, {_graded_sql(_LENIENT)} AS same FROM d) SELECT doc_id, formatted, formatted AND same AS correct FROM r""")
def grade_think_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a tag after the thoughts, boxed or not; one in four has the tag in another place."""
    given, truth = _answers(_LENIENT)
    gap = F.when(F.col("doc_id") % 4 == 1, F.lit("\n")).otherwise(F.lit(" "))
    answer = F.when(F.col("doc_id") % 2 == 0, given).otherwise(F.concat(F.lit("it is \\boxed{"), given, F.lit("}")))
    reply = F.concat(F.lit("<think>an <answer>1</answer>?</think>"), gap, F.lit("<answer>"), answer, F.lit("</answer>"))
    return table(spark, sf_dir, "documents").select("doc_id", algebra.graded_tag(reply, F.array(truth)).alias("g")).select("doc_id", "g.*")


@query("math_repetition")
def math_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (mt.repetition("text") > 0.2).alias("repetitive"), mt.strip_accents("text").alias("plain"))


@query("reward_on_last_token", """WITH t AS (SELECT user_id AS seq, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id) AS n FROM events)
  SELECT seq, pos, CASE WHEN pos = n - 1 THEN 2.5 ELSE 0.0 END::DOUBLE AS reward FROM t""")  # fmt: skip
def reward_on_last_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.plans.bindings import exploded, sequences

    rows = sequences(spark, sf_dir, "m")
    return exploded(rows.withColumn("x", g.reward_at_last(F.lit(2.5), F.col("m"))), "x", "reward")
