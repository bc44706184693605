"""Answers from responses: extraction, normalisation and grading, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.tokens import let

# Markers, words and patterns that the graded formats define.
ASSISTANT_MARKS = ("<|im_start|>assistant", "<|start_header_id|>assistant<|end_header_id|>")
END_MARKS = ("<|im_end|>", "<|eot_id|>")
HASH_ANSWER = r"####\s*(-?[0-9.,$]+)"
LOOSE_NUMBER = r"(-?[0-9.,]{1,})"
ARTICLES = r"\b(a|an|the)\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def last(items: Column) -> Column:
    """The last item of an array; null if it is empty."""
    return F.get(items, F.size(items) - 1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def model_response(text: Column) -> Column:
    """After the right-most assistant mark, up to the first end mark."""
    tail = text
    for mark in ASSISTANT_MARKS:
        tail = F.substring_index(tail, mark, -1)
    for mark in END_MARKS:
        tail = F.substring_index(tail, mark, 1)
    return tail


def strict_number(text: Column) -> Column:
    """The last ``#### number`` without commas and dollar signs."""
    return F.regexp_replace(last(found(text, HASH_ANSWER)), "[,$]", "")


def loose_number(text: Column) -> Column:
    """The last number-like token that isn't a mere dot; commas stay. If none is good, the first one."""
    every = found(text, LOOSE_NUMBER)
    return F.coalesce(last(F.filter(every, lambda x: ~x.isin("", "."))), F.get(every, F.lit(0)))


def first_number(text: Column) -> Column:
    """The first ``#### number`` without commas; an error without one."""
    got = F.get(found(text, r"####\s*(-?[0-9.,]+)"), F.lit(0))
    return F.when(got.isNull(), F.raise_error(F.lit("no final answer")).cast("string")).otherwise(F.replace(got, F.lit(",")))


def repeated_markers(text: Column) -> Column:
    """More than one ``####`` answer or more than one boxed answer in the response."""
    r = model_response(text)
    return (F.size(found(r, HASH_ANSWER)) > 1) | (F.size(found(r, r"(\\boxed)")) > 1)


def number_score(text: Column, truth: Column, check_repeats: bool = True) -> Column:
    """(reward, completed): an answer was found, and it equals the truth."""
    answer = loose_number(model_response(text))
    bad = repeated_markers(text) if check_repeats else F.lit(False)
    reward = F.when(bad | answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(0.0)
    return F.struct(reward.alias("reward"), F.when(bad | answer.isNull(), 0).otherwise(1).alias("completed"))


def plain_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, articles and surplus white space, in this order."""
    bare = F.regexp_replace(F.lower(text), "[" + re.escape(PUNCTUATION) + "]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), r"\s+", " "))


def exact_match(text: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: plain_answer(g) == plain_answer(text))


def sub_match(text: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(plain_answer(text), plain_answer(g)))


# Where an answer stands in a reply about tables.
ANSWER_BLOCK = r"(?s)<Answer>(.*?)</Answer>"
THOUGHTS = r"(?s)<Analyze>(.*?)</Analyze>"
AFTER_THOUGHTS = r"(?s)<Analyze>.*?</Analyze>\s*(.*)"
ANSWER_MARK = "Answer:"
SAID = r"(?i)(?:the\s+answer\s+is\s*:?\s*)([^\n]*?)(?:$|\.|\n)"
CONCLUDED = r"(?i)(?:therefore|thus|so|hence|consequently|in conclusion)[,:]?\s+([^\n]*?)(?:$|\.|\n)"


def table_reply_answer(text: Column, by_line: bool = False) -> Column:
    """The answer in a reply about tables; null counts as empty, and an empty answer as none.

    It is looked for in the answer block, else after the mark (the rest of its last line, ``by_line``, or of the reply), else in the whole reply (or
    its last line). What follows the thoughts counts, else what they say the answer is or conclude; then what is said to be the answer, without quotes.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    first = lambda c, pattern: F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), 0)
    after_mark = lambda c: F.substring_index(c, ANSWER_MARK, -1)
    text = F.coalesce(text, F.lit(""))
    block = strip(first(text, ANSWER_BLOCK))
    marked = F.when(F.contains(text, F.lit(ANSWER_MARK)), last(F.regexp_extract_all(text, F.lit(ANSWER_MARK + r"\s*([^\n]*)"), F.lit(1))) if by_line else after_mark(text))
    rest = F.substring_index(strip(text), "\n", -1) if by_line else text
    raw = F.regexp_replace(strip(F.coalesce(F.when(F.contains(block, F.lit(ANSWER_MARK)), after_mark(block)).otherwise(block), marked, rest)), "</?Answer>", "")
    thoughts, after = first(raw, THOUGHTS), strip(first(raw, AFTER_THOUGHTS))
    thought = F.when(after == "", F.coalesce(F.regexp_replace(strip(first(thoughts, SAID)), r"""^["'](.*?)["']\.?$""", "$1"), strip(first(thoughts, CONCLUDED))))
    shown = F.when(after != "", after).otherwise(raw)
    return F.coalesce(thought, F.regexp_replace(strip(first(shown, SAID)), r"""^["'](.*)["']$""", "$1"), strip(shown))


def table_reply_score(text: Column, truth: Column, by_line: bool = False) -> Column:
    """(reward, completed): the answer is the truth in plain form; without an answer neither."""
    answer = table_reply_answer(text, by_line)
    reward = F.when(answer == "", 0.0).when(plain_answer(answer) == plain_answer(truth), 1.0).otherwise(0.0)
    return F.struct(F.coalesce(reward, F.lit(0.0)).alias("reward"), F.when(answer == "", 0).otherwise(1).alias("completed"))


def tag_answer(text: Column, least: int = 1) -> Column:
    """The last ``<answer>`` block, if there are ``least`` of them."""
    every = found(text, r"(?s)<answer>(.*?)</answer>")
    return F.when(F.size(every) >= least, F.trim(last(every)))


def tag_score(text: Column, golds: Column, match=exact_match, score: float = 1.0, format_score: float = 0.0) -> Column:
    """``score`` for a match (a quarter with more than ten tags), ``format_score`` for another answer, 0 without one."""
    answer = tag_answer(text)
    tags = F.regexp_count(text, F.lit("<answer>"))
    return F.when(answer.isNull(), 0.0).when(match(answer, golds), F.when(tags > 10, score / 4).otherwise(score)).otherwise(format_score)


def information_blocks(text: Column) -> Column:
    return found(text, r"(?s)<information>(.*?)</information>")


def retrieval_correct(text: Column, golds: Column) -> Column:
    return F.exists(information_blocks(text), lambda b: F.exists(golds, lambda g: F.contains(plain_answer(b), plain_answer(g))))


def valid_sequence(text: Column, loose: bool = False) -> Column:
    """Whether the tags form think, (search, information, think …), answer, with nothing but white space between blocks.

    ``loose``: tags must balance and end in an answer, in any order before that."""
    tags = found(text, r"(</?(?:think|search|information|answer)>)")
    balanced = lambda t: F.regexp_count(text, F.lit(f"<{t}>")) == F.regexp_count(text, F.lit(f"</{t}>"))
    even = balanced("think") & balanced("search") & balanced("information") & balanced("answer")
    if loose:
        return even & (last(tags) == "</answer>")
    # States: 0 start, 1 in think, 2 after think, 3 in search, 4 after search, 5 in information, 6 after information, 7 in answer, 8 end, -1 error.
    moves = {(0, "<think>"): 1, (1, "</think>"): 2, (2, "<search>"): 3, (3, "</search>"): 4, (4, "<information>"): 5, (5, "</information>"): 6, (6, "<think>"): 1, (2, "<answer>"): 7, (7, "</answer>"): 8}
    table = F.create_map(*[F.lit(x) for (s, t), to in moves.items() for x in (f"{s}{t}", to)])
    state = F.aggregate(tags, F.lit(0), lambda s, t: F.coalesce(F.try_element_at(table, F.concat(s.cast("string"), t)), F.lit(-1)))
    outside = F.regexp_replace(text, r"(?s)<(think|search|information|answer)>.*?</\1>", "")
    return even & (state == 8) & (F.trim(F.regexp_replace(outside, r"\s+", "")) == "")


def format_matrix(answered: Column, matched: Column, formatted: Column, retrieved: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1, score: float = 1.0) -> Column:
    """Reward by answer, match, format and retrieval."""
    lower = F.when(formatted, F.when(retrieved, structure + retrieval).otherwise(structure))
    return (
        F.when(~answered, lower.otherwise(0.0))
        .when(matched, F.when(formatted, score).otherwise(score - structure))
        .otherwise(lower.otherwise(final))
    )


def number_and_unit(text: Column) -> Column:
    """The first number of a text (``.5`` too; null if there is none), and its unit: the first of %, million, billion and $ that occurs."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"([-+]?[0-9]*\.?[0-9]+)", 1)
    unit = F.when(F.contains(t, F.lit("%")), "%").when(F.contains(t, F.lit("million")), "million").when(F.contains(t, F.lit("billion")), "billion").when(F.contains(t, F.lit("$")), "$").otherwise("")
    return F.struct(F.when(n != "", n).try_cast("double").alias("number"), unit.alias("unit"))


def finance_match(answer: Column, truth: Column) -> Column:
    """Texts without a number must be equal, but for case and outer space. Numbers match within 0.01; else a percentage matches only a
    percentage, within 0.15 after rounding to one decimal, and other numbers within 5 % of the truth (of 1 at least)."""

    def judge(pair: Column) -> Column:
        a, t = pair.getField("a"), pair.getField("t")
        x, y = a.getField("number"), t.getField("number")
        rate, true_rate = a.getField("unit") == "%", t.getField("unit") == "%"
        return (
            F.when(x.isNull() | y.isNull(), pair.getField("same")).when(F.abs(x - y) < 0.01, True).when(rate != true_rate, False)
            .when(rate, F.abs(F.bround(x, 1) - F.bround(y, 1)) < 0.15).otherwise(F.abs(x - y) / F.greatest(F.abs(y), F.lit(1.0)) < 0.05)
        )

    same = F.lower(F.trim(answer)) == F.lower(F.trim(truth))
    return let(F.struct(number_and_unit(answer).alias("a"), number_and_unit(truth).alias("t"), same.alias("same")), judge)


def numeric_equal(a: Column, b: Column, relative: float = 1e-4) -> Column:
    """Close as of ``isclose`` with a relative tolerance; NaN equals nothing, equal infinities each other."""
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | ((F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))))


def number_or_text(answer: Column, truth: Column, relative: float = 1e-5) -> Column:
    """Numbers within a relative tolerance (around 0: absolute), else equal plain texts."""
    a, b = (F.regexp_replace(F.trim(x), "[,$%]", "").try_cast("double") for x in (answer, truth))
    near = F.when(b == 0, F.abs(a) <= relative).otherwise(F.abs(a - b) <= relative * F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull(), near).otherwise(plain_answer(answer) == plain_answer(truth))


def named_values(text: Column) -> Column:
    """``@name[value]`` pairs as a map; of repeated names the last."""
    names, values = found(text, r"@(\w+)\[(.*?)\]", 1), found(text, r"@(\w+)\[(.*?)\]", 2)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    keep = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q.getField("k") == p.getField("k")))
    return F.map_from_entries(keep)


def named_score(text: Column, truth: Column) -> Column:
    """(reward, completed): every name of ``truth`` (a map) is there, and every value equals its own, numbers within 1e-6."""
    got = named_values(text)
    same = lambda v, t: F.coalesce(F.abs(v.try_cast("double") - t.try_cast("double")) <= 1e-6, v == t)
    there = F.forall(F.map_keys(truth), lambda k: F.coalesce(F.map_contains_key(got, k), F.lit(False)))
    right = F.forall(F.map_entries(truth), lambda e: F.coalesce(same(F.try_element_at(got, e.getField("key")), e.getField("value")), F.lit(False)))
    return F.struct(F.when(there & right, 1.0).otherwise(0.0).alias("reward"), there.cast("int").alias("completed"))


def execute_pass_ratio(text: Column, error: str = "[Error]:") -> Column:
    """Share of ``<Execute>`` blocks without an error; 0 without blocks."""
    every = found(text, r"(?s)<Execute>(.*?)</Execute>")
    good = F.filter(every, lambda b: ~F.contains(b, F.lit(error)))
    return F.when(F.size(every) == 0, 0.0).otherwise(F.size(good) / F.greatest(F.size(every), F.lit(1)))


def has_tags(text: Column, *tags: str) -> Column:
    out = F.lit(True)
    for t in tags:
        out = out & F.contains(text, F.lit(f"<{t}>")) & F.contains(text, F.lit(f"</{t}>"))
    return out


def code_blocks_fenced(text: Column) -> Column:
    """Every ``<Code>`` block is one fenced Python block."""
    return F.forall(found(text, r"(?s)<Code>(.*?)</Code>"), lambda b: F.trim(b).rlike(r"(?s)^\s*```python\n.*```\s*$"))


def judged(reply: Column, label: str, most: int) -> Column:
    """The last ``label: n`` of a judge's reply over ``most``; an error outside 0 … most."""
    n = last(found(reply, rf"{re.escape(label)}:\s*(\d+)")).cast("int")
    return F.when(n.isNull() | (n > most), F.raise_error(F.concat(F.lit(f"no {label} in: "), F.substring(reply, 1, 80))).cast("double")).otherwise(n / most)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """min(-(length - (most - buffer)) / buffer * factor, 0)."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def reward_at_last(reward: Column, mask: Column) -> Column:
    """Zeros with the reward on the last masked-in token."""
    at = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int")) - 1
    return F.transform(mask, lambda m, i: F.when(i == at, reward.cast("double")).otherwise(0.0))


def segments(text: Column) -> Column:
    """Alternating ``<code>``, ``<interpreter>`` and ``<answer>`` blocks as (kind, body)."""
    whole = r"(?s)<(code|interpreter|answer)>(.*?)</\1>"
    return F.zip_with(found(text, whole, 1), found(text, whole, 2), lambda k, b: F.struct(k.alias("kind"), F.trim(b).alias("body")))


def media_parts(text: Column) -> Column:
    """Content split at ``<image>`` and ``<video>`` marks into typed parts."""
    pieces = found(text, r"(?s)(<image>|<video>|(?:(?!<image>|<video>).)+)")
    return F.transform(pieces, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def passages(items: Column) -> Column:
    """Ranked passages as numbered text; a passage's first line is its title."""
    return F.array_join(F.transform(items, lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(p, "\n", 1), F.lit(")\n"), F.when(F.contains(p, F.lit("\n")), F.substring(p, F.locate("\n", p) + 1, 1 << 30)).otherwise(""))), "\n")


def table_text(header: Column, rows: Column) -> Column:
    """A table as lines of cells with bars between."""
    line = lambda r: F.array_join(r, " | ")
    return F.concat_ws("\n", line(header), F.array_join(F.transform(rows, line), "\n"))


def cleaned(text: Column) -> Column:
    """Trimmed; `` [title]`` becomes ``. ``, other brackets go, double spaces become one."""
    return F.replace(F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def tool_calls(text: Column) -> Column:
    """(name, arguments) of ``<tool_call>`` JSON blocks; blocks that aren't JSON with a name are left out."""
    every = F.transform(found(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(every, lambda c: c.getField("name").isNotNull())


# What the answer format of quantitative reasoning sets replaces and removes, in this order.
SUBSTITUTIONS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
REWRITES = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}"),
)


def quantity_form(answer: Column) -> Column:
    """The normal form of a final answer: after the last ``=``, with units and LaTeX dressing removed."""
    out = F.substring_index(answer, "=", -1)
    for a, b in SUBSTITUTIONS:
        out = F.replace(out, F.lit(a), F.lit(b))
    for a in REMOVED:
        out = F.replace(out, F.lit(a), F.lit(""))
    for a, b in REWRITES:
        out = F.regexp_replace(out, a, b)
    out = F.replace(out, F.lit("$"), F.lit(""))
    bare = F.replace(out, F.lit(","), F.lit(""))
    return F.trim(F.when(bare.rlike(r"^\d+$"), bare).otherwise(out))


def quantity_answer(text: Column) -> Column:
    """The normal form of what follows the last ``Answer:``; ``[INVALID]`` without one."""
    return quantity_form(F.coalesce(last(found(text, r"(?i)Answer\s*:\s*([^\n]+)")), F.lit("[INVALID]")))


def quantity_score(text: Column, truth: Column) -> Column:
    """(score, acc, pred) from a response's last 300 characters: 1 or -1."""
    pred = quantity_answer(F.right(text, F.lit(300)))
    acc = pred == quantity_form(truth)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


#: Units that stay with their number, and spans of time by another name.
UNITS = ("days", "years", "pages", "km/h", "mph")
PERIODS = {"1 week": "7 days", "2 weeks": "14 days", "1 year": "12 months"}


def table_answer(text: Column) -> Column:
    """A table question's answer in one spelling: numbers without commas (with a known unit too), whole floats as integers, known spans of
    time, lists sorted and joined by ``|``; other texts lower-cased, without accents, punctuation and surplus white space. Null is empty."""
    from rillflow.functions.mathtext import strip_accents

    def of(t: Column) -> Column:
        with_unit = "^([\\d,]+)\\s*(" + "|".join(UNITS) + ")$"
        number = F.replace(t, F.lit(",")).try_cast("double")
        items = F.filter(F.transform(F.split(t, r"[|,]\s*"), lambda x: F.trim(x)), lambda x: x != "")
        words = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(t), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))
        period = F.coalesce(*[F.when(t == k, v) for k, v in PERIODS.items()])
        return (
            F.when(t == "", "").when(t.rlike(with_unit), F.concat_ws(" ", F.replace(F.regexp_extract(t, with_unit, 1), F.lit(",")), F.regexp_extract(t, with_unit, 2)))
            .when(t.rlike(r"^[\d,]+$"), F.replace(t, F.lit(","))).when(period.isNotNull(), period)
            .when(number.isNotNull() & (F.abs(number) < 1e15), F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string")))
            .when(F.contains(t, F.lit("|")) | F.contains(t, F.lit(",")), F.array_join(F.array_sort(items), "|")).otherwise(words)
        )

    return of(F.trim(F.lower(F.coalesce(text, F.lit("")))))


def table_match(answer: Column, truth: Column) -> Column:
    """Equal in one spelling; or the truth is the answer with a unit; or both are lists of the same items."""
    a, t = table_answer(answer), table_answer(truth)
    unit = r"^(\d+)\s+([a-z/]+)$"
    bare = a.rlike(r"^\d+$") & t.rlike(unit) & (a == F.regexp_extract(t, unit, 1))
    x, y = (F.array_sort(F.array_distinct(F.split(F.lower(c), r"[|,]\s*"))) for c in (answer, truth))
    return F.coalesce((a == t) | bare | ((F.size(x) > 1) & (x == y)), F.lit(False)) & answer.isNotNull() & truth.isNotNull()


def strict_box(text: Column, truth: Column, tail: int = 100) -> Column:
    """1 if the last boxed answer within the last ``tail`` characters is exactly the truth, else -1."""
    from rillflow.functions.mathtext import boxed_answer

    return F.when(F.coalesce(boxed_answer(F.right(text, F.lit(tail))) == truth, F.lit(False)), 1).otherwise(-1)


def boxed_and_format(text: Column, truth: Column, use_boxed: bool = True, format_score: float = 0.1) -> Column:
    """(1 - ``format_score``) for a right answer and ``format_score`` for thoughts in tags followed by a boxed answer."""
    from rillflow.functions.mathtext import boxed_answer, math_equal

    right = F.coalesce(math_equal(boxed_answer(text) if use_boxed else text, truth), F.lit(False))
    shaped = text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")
    return (1 - format_score) * right.cast("double") + format_score * shaped.cast("double")


#: What a judge of a report must score.
SOUNDNESS = ("faithfulness", "instruction_answering", "analytical_depth", "process_coherence", "visualization")


def soundness(reply: Column) -> Column:
    """The five scores, 0 to 4, of the last fenced JSON of a judge's reply (of the whole reply without a fence); an error where one lacks or is out of range."""
    body = F.coalesce(last(found(reply, r"(?is)```json(.*?)```")), last(found(reply, r"(?s)```(.*?)```")), reply)
    scores = F.from_json(F.trim(body), "map<string,double>")
    bad = F.exists(F.array(*[F.lit(k) for k in SOUNDNESS]), lambda k: F.coalesce(~F.try_element_at(scores, k).between(0.0, 4.0), F.lit(True)))
    kept = F.struct(*[F.try_element_at(scores, F.lit(k)).alias(k) for k in SOUNDNESS])
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("no soundness scores in: "), F.substring(reply, 1, 80))).cast(", ".join(f"{k}: double" for k in SOUNDNESS).join(["struct<", ">"]))).otherwise(kept)


def verdict(reply: Column) -> Column:
    """The last ``Final Score:`` of a judge's reply; an error unless it is 0 or 1."""
    n = last(found(reply, r"(?i)(?:###\s*)?Final\s*Score\s*:\s*([\d.]+)")).try_cast("double")
    return F.when(F.coalesce(n.isin(0.0, 1.0), F.lit(False)), n).otherwise(F.raise_error(F.concat(F.lit("no final score of 0 or 1 in: "), F.substring(reply, 1, 80))).cast("double"))
