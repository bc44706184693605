"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

All DataFrame expressions. Counts are array expressions within the row: nothing is exploded or shuffled, so a hot
source or a very long text stays one row in one task.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.tables import cut


@dataclass(frozen=True)
class QualityRule:
    """Rejects a row where ``rejects`` holds, an expression over ``COUNTS`` and ``body``."""

    name: str
    rejects: str


#: Over the counts below and ``body`` (the text, null as empty). Symbol soup, shouting, repeated lines, odd words.
RULES = (
    QualityRule("symbols", "100 * n_symbols > 30 * n_words"),
    QualityRule("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    QualityRule("repeated_lines", "2 * n_dup_lines > n_lines"),
    QualityRule("shouting", "100 * regexp_count(body, '!!') > 30 * n_words"),
    QualityRule("capitals", "100 * regexp_count(body, '[A-Z]') > 60 * word_chars"),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _let(names: dict[str, str], body: str) -> str:
    """``body`` with names for expressions. As one expression it stays one however often the optimiser moves it."""
    for name, value in reversed(names.items()):
        body = f"get(transform(array({value}), {name} -> {body}), 0)"
    return body


def counted(text: str, result: str) -> Column:
    """``result``, an expression over ``body`` (the text, null as empty) and ``COUNTS``.

    n_repeat_words: the starts of windows are sorted by the windows' 64-bit hash; those with an equal neighbour
    repeat, and in position order each adds the words (3 at most) that the start before it did not cover.
    """
    names = {
        "body": f"coalesce(`{text}`, '')",
        "w": r"array_remove(split(body, r'[\x20\x09-\x0D]+'), '')",
        "l": r"filter(split(body, '\n'), x -> rlike(x, r'[^\x20\x09-\x0D]'))",
        "n_words": "cast(size(w) as bigint)",
        "word_chars": "cast(length(array_join(w, '')) as bigint)",
        "n_symbols": "cast(length(regexp_replace(body, '[^#*$%&|<>]+', '')) as bigint)",
        "n_lines": "cast(size(l) as bigint)",
        "n_dup_lines": "n_lines - size(array_distinct(l))",
        "h": "if(n_words < 4, array(), transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))))",
        "s": "if(size(array_distinct(h)) = size(h), array(), sort_array(transform(h, (x, i) -> struct(x as h, i as i))))",
        "p": "sort_array(transform(filter(s, (x, j) -> coalesce(x.h = get(s, j - 1).h, false) or coalesce(x.h = get(s, j + 1).h, false)), x -> x.i))",
        "n_repeat_words": "aggregate(p, struct(-3 as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n)).n",
    }
    return F.expr(_let(names, result))


def estimates(docs: DataFrame, rules: Sequence[QualityRule] = RULES, sample_rows: int = 2000, text: str = "text") -> dict[str, tuple[float, float]]:
    """Rejection rate and seconds a row of each rule, measured on a random sample of about ``sample_rows`` rows.

    The sample, with its counts, is a table in the shared folder. Each rule is run over it by itself: the time that
    takes beyond a scan that reads the same columns is its cost. What comes back are counts.
    """
    rows = docs.count()
    some = docs.sample(False, min(1.0, sample_rows / max(1, rows)), 17)
    counts = ", ".join(COUNTS)
    sample = cut(some.select(counted(text, f"struct({counts}, body)").alias("s")).select("s.*"), "sample")
    n = max(1, sample.count())

    def run(condition: str) -> tuple[int, float]:
        best, found = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            found = sample.agg(F.count_if(F.expr(condition)), F.max(F.length("body")), *[F.max(c) for c in COUNTS]).first()[0]
            best = min(best, time.perf_counter() - began)
        return found, best

    run("true")
    base = run("true")[1]
    measured = {r.name: run(r.rejects) for r in rules}
    return {name: (found / n, max(took - base, 1e-4) / n) for name, (found, took) in measured.items()}


def cascade(docs: DataFrame, rules: Sequence[QualityRule] = RULES, sample_rows: int = 2000, text: str = "text") -> list[QualityRule]:
    """``rules`` in the order to run them: rejection rate per second, as ``estimates`` measures them."""
    known = estimates(docs, rules, sample_rows, text)
    return sorted(rules, key=lambda r: -known[r.name][0] / known[r.name][1])


def quality(docs: DataFrame, rules: Sequence[QualityRule] = RULES, sample_rows: int = 2000, text: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS``, base_failed, rejected_by (the first rule of the cascade that rejects; null if none) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. Other rows pass through
    the cascade: a ``CASE`` whose branches Spark evaluates one after the other, so a row that an early rule rejects
    costs nothing further. ``kept`` does not depend on the order of the rules. Null text counts as empty and fails
    the base; repeated rows give repeated results; an empty table gives none. A column of ``docs`` with the name of
    a result is replaced.
    """
    made = {*COUNTS, "base_failed", "rejected_by", "kept", "_judged"}
    given = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in made])
    order = cascade(given, rules, sample_rows, text)
    branches = " ".join(f"when {r.rejects} then '{r.name}'" for r in order)
    result = f"struct({', '.join(COUNTS)}, {BASE_FAILED} as base_failed, case when {BASE_FAILED} then 'base' {branches} end as rejected_by)"
    judged = given.withColumn("_judged", counted(text, result))
    return judged.select(*[f"`{c}`" for c in given.columns], "_judged.*", F.col("_judged.rejected_by").isNull().alias("kept"))
