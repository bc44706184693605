"""Collocations, page texts and hard negatives against brute force."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillflow.llm import collocations, hard_negatives, page_text, queries

DATA = os.environ.get("RILLFLOW_DATA", "/root/testdata/sf0.001")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", ["op5_tree_forest", "op8_odd_sketches", "op10_substring_dedup", "op11_collocations", "op12_page_text", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cursor = c.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(rows_of(df.select(*names)), key=str) == sorted(cursor.fetchall(), key=str)


# Collocations


def brute_collocations(docs, least, top, percent):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                f.update((lang, tuple(w[i : i + d])) for i in range(len(w) - d + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(k[0] == lang and len(k[1]) > len(p) and 100 * b >= percent * a and any(k[1][i : i + len(p)] == p for i in range(len(k[1]))) for k, b in found.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def corpus(seed, size=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "x", "a-b", "Straße", "zz", "é"]
    docs = [("en", None), (None, "the of the of. the of"), ("", " \t "), ("de", ""), ("en", "...;;"), ("fr", "a b" * 3)]
    for _ in range(size):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!"]) for _ in range(rng.randint(0, 90)))
        docs += [(rng.choice(["en", "en", "de", None]), text)] * rng.choice([1, 1, 3])
    return docs


@pytest.mark.parametrize(("least", "top", "percent"), [(30, 2000, 80), (5, 40, 50), (1, 7, 100)])
def test_collocations_equal_brute_force(spark, least, top, percent):
    docs = corpus(least, 40 if least == 1 else 120)
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "lang string, text string, w1 int, n int, rank int").repartition(3)
    assert sorted(rows_of(collocations.collocations(df, least, top, percent))) == brute_collocations(docs, least, top, percent)


def test_collocations_of_nothing(spark):
    assert rows_of(collocations.collocations(spark.createDataFrame([], "lang string, text string"))) == []
    assert rows_of(collocations.collocations(spark.createDataFrame([("en", "a b " * 20)], "lang string, text string"))) == []


def test_collocation_scores_beyond_64_bits(spark):
    a, left, right = (1 << 62) + 1, [(1 << 62) + 7, (1 << 62) + 1], [(1 << 62) + 3, (1 << 62) + 9]
    df = spark.createDataFrame([(a, left, right)], "a bigint, lefts array<bigint>, rights array<bigint>").select(collocations._score().alias("s"))
    cuts = [(2000000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(zip(left, right))]
    assert tuple(rows_of(df)[0][0]) == min(cuts)


def test_ranges_of_paths():
    rng = np.random.default_rng(2)
    paths = np.unique(rng.integers(-2, 3, (200, 3)), axis=0)
    bounds = np.unique(rng.integers(-2, 3, (7, 3)), axis=0)
    run = pa.RecordBatch.from_arrays([pa.array(paths[:, i]) for i in range(3)], names=["w1", "w2", "w3"])
    want = [sum(tuple(b) <= tuple(p) for b in bounds.tolist()) for p in paths.tolist()]
    assert collocations._ranges(run, ["w1", "w2", "w3"], bounds).tolist() == want


def test_runs_of_deep_tries_are_sorted_into_their_ranges():
    """Paths of three and four words in one run: in the order that Spark sorts them, each in the range that its bounds say."""
    rng = random.Random(5)
    text = " ".join(rng.choice(["ab", "b", "c"]) for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, text[:900]])], names=["lang", "text"])

    class Every:
        value = np.full(collocations.BITMAP_WORDS, (1 << 64) - 1, np.uint64)

    def rows(bounds):
        out = []
        for run in collocations._runs(collocations._deep(3, 4, 2, Every), collocations.PATH, bounds)(iter([batch])):
            out += zip(*[run.column(i).to_pylist() for i in range(6)])
        return out

    every = [r[:4] for r in rows(np.zeros((0, 4), np.int64))]
    assert every == sorted(every) and len(set(every)) == len(every) == 2 * (27 + 81)
    bounds = np.array(sorted(rng.sample(every, 40)))
    for r in rows(bounds):
        assert r[5] == sum(tuple(b) <= r[:4] for b in bounds.tolist())


def test_runs_of_a_shard_are_sorted_and_whole(monkeypatch):
    """Runs that are written early, and texts that come in several ranges, count as one."""
    rng = random.Random(3)
    text = "".join(rng.choice("abc") * rng.randint(1, 3) + rng.choice("   .") for _ in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "x"])], names=["lang", "text"])

    bounds = np.array([[-(1 << 62)], [0], [1 << 61]])

    def counted(limit, runs):
        monkeypatch.setattr(collocations, "RUN_PATHS", runs)
        each = collocations._each
        monkeypatch.setattr(collocations, "_each", lambda b: each(b, limit))
        out, total = list(collocations._runs(collocations._single, ["w1"], bounds)(iter([batch]))), Counter()
        monkeypatch.setattr(collocations, "_each", each)
        for run in out:
            assert sorted(run.column("w1").to_pylist()) == run.column("w1").to_pylist()
            assert [sum(w >= b for b in bounds[:, 0]) for w in run.column("w1").to_pylist()] == run.column("range").to_pylist()
            for word, n in zip(run.column("word").to_pylist(), run.column("n").to_pylist()):
                total[word] += n
        return len(out), total

    many, total = counted(64, 4)
    assert many > 1
    assert (1, total) == counted(1 << 20, 1 << 20)
    assert total == Counter(re.findall("[^ .]+", text)) + Counter(["x"])


# Page texts

FRAME = '<html><head><title>T</title></head><body><div class="top"><p>Welcome to our site</p><ul><li>Home<li>News</ul></div>{}<div id="low">All rights kept by us</div></body></html>'


def test_page_parts():
    page = page_text.Page(
        '<html><head><meta charset=utf-8><title>a</title><style>p{}</style><script>var t="</p>";</script><body class="with-sidebar"><nav><ul><li><a href="/x">x</a></ul></nav><!-- ad --><div class="ad">Buy</div>'
        '<article class=post><header class="entry-header"><h1>Big &amp; \n bold &copy; &am</h1>by me</header><p><b>One a < b &lt;i&gt;<br>two<p>A&nbsp;b in<i>li</i>ne</b> rest<form><input value=1>Mail?</form>'
        '<div role="navigation">next</div><div style="display: none">secret</div><aside>side</aside><ul><li>l1<li>l2</ul><table><tr><td>c1<td>c2<tr><td>c3</table><div id="comments"><article class="comment"><p>first!</p></article></div>'
        "<footer>by</footer></article><footer>&copy; host"
    )
    assert page.text(frozenset()) == ("Big & bold © &am\nOne a < b <i> two\nA b inline rest\nl1\nl2\nc1\nc2\nc3", 0)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<article></article><p>x", "x"),
        ("<main><h1>t</h1><article>a</article></main>", "a"),
        ("<main>m</main>rest", "m"),
        ("<article>a</article><div><article>b</article></div>c", "a\nb"),
        ("<b>x<p>y</b>z", "x\nyz"),
        ("a<script>never ends <p>", "a"),
        ("a<!-- never ends <p>", "a"),
        ('<p title="a>b" x=\'c>d\'>e</p>', "e"),
        ('<p title="open>e', "e"),
        ("</p></div>x</article>", "x"),
        ("<div class='has-sidebar'><article><p>" + "w " * 50 + "</p></article></div>", " ".join(["w"] * 50)),
        ("<body><div class='page header-x'>" + "all of it " * 20 + "</div></body>", " ".join(["all of it"] * 20)),
        ("<p>&#x41;&#0;&amp;lt;&eacute;</p>", "A�&lt;é"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ],
)
def test_pages_of_any_form(html, text):
    assert page_text.Page(html).text(frozenset())[0] == text


@pytest.mark.parametrize("most", [1 << 25, -1])
def test_site_templates(spark, monkeypatch, most):
    """Templates broadcast, and joined by host where they are too many for that."""
    monkeypatch.setattr(page_text, "BROADCAST_BYTES", most)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    body = [" ".join(word() for _ in range(60)) for _ in range(12)]
    pages, want = [], {}
    for i, b in enumerate(body):
        pages.append((i, f"http://A.example/{i}", FRAME.format(f"<div><p>{b}</p></div>")))
        want[i] = b
    # Copies of a page on another host, all alike: no template there.
    for i in range(20, 30):
        pages.append((i, "http://b.example/", FRAME.format("<div><p>one page</p></div>")))
        want[i] = "Welcome to our site\nHome\nNews\none page\nAll rights kept by us"
    # A marked article keeps the paragraph that its site repeats, and loses a box that it repeats.
    for i in range(30, 40):
        pages.append((i, "http://c.example/", f"<article><h1>Daily</h1><p>Said before.</p><p>{body[i - 30]}</p><section>Read more: <p>a list</p></section></article>"))
        want[i] = f"Daily\nSaid before.\n{body[i - 30]}"
    # Without a host there is no site.
    for i in range(40, 50):
        pages.append((i, None, FRAME.format(f"<p>{body[i - 40]}</p>")))
        want[i] = f"Welcome to our site\nHome\nNews\n{body[i - 40]}\nAll rights kept by us"
    pages += [(50, "http://A.example/", None), (51, "http://A.example/", "")]
    want |= {50: "", 51: ""}
    df = spark.createDataFrame([(*p, "mine", 5, "x") for p in pages], "page_id int, url string, html string, host string, `n chars` int, templates string").repartition(5)
    out = page_text.page_texts(df)
    assert out.columns == ["page_id", "url", "host", "n chars", "templates", "text", "n_chars", "n_template"]
    got = {r["page_id"]: r for r in out.collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["host"] == "mine" and r["n chars"] == 5 and r["templates"] == "x" for r in got.values())
    assert got[0]["n_template"] == 2 and got[30]["n_template"] == 1 and got[20]["n_template"] == 0
    assert rows_of(page_text.page_texts(df.limit(0))) == []


# Hard negatives


def brute_negatives(rows, anchors, limits):
    ok = [(i, [math.floor(256 * x) for x in e], k) for i, e, k in rows if i is not None and k is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, e, k in {(i, tuple(e), k) for i, e, k in ok if anchors(i)}:
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, m) for j, f, m in ok if len(f) == len(e))
        for s, j, _ in [r for r in scored if r[2] == k and r[1] != i][: limits.positives]:
            fits = [r for r in scored if r[2] != k and limits.lower * -s <= -100 * r[0] <= limits.upper * -s]
            out += [(i, j, n, m, -s, -t) for n, (t, m, _) in enumerate(fits[: limits.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_hard_negatives_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(4)
    common = [float(x) for x in rng.normal(size=6)]
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)] if i % 4 else common, int(rng.integers(0, 3))) for i in range(-20, 200)]
    rows += rows[5:30] + [(7, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (21, [1.0, 1.5], 0), (22, [2.0, 2.0], 1), (10, [], 1), (11, [], 1), (12, [], 2)]
    rows += [(None, common, 1), (40, None, 1), (50, common, None), (60, [*common[:5], None], 1), (70, [*common[:5], math.nan], 2), (80, [*common[:5], math.inf], 2), (90, [0.0] * 6, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, anchor string, score int").repartition(3)
    for limits in (hard_negatives.Limits(), hard_negatives.Limits(3, 2, 10, 100)):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, limits, block_bytes)
        assert sorted(rows_of(got)) == brute_negatives(rows, lambda i: i % 10 == 0, limits)
    assert rows_of(hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0)) == []


def test_hard_negatives_beyond_doubles(spark):
    """Components too large for exact doubles are multiplied as whole numbers."""
    rows = [(0, [3456789.0, 3.0], 0), (1, [3456789.0, 1 / 256], 0), (2, [2765431.0, 5.0], 1), (3, [2765431.0, 5 + 1 / 256], 1), (4, [1e300, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(rows_of(hard_negatives.hard_negatives(df, F.col("vec_id") == 0)))
    assert got == brute_negatives(rows[:4], lambda i: i == 0, hard_negatives.Limits())
