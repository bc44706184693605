"""Substring dedup by bytes and by words against brute force."""

import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest

from rillflow.llm import repeats, substring_dedup, suffix_dedup


def brute_bytes(rows, span):
    """Every window's places, each row a document of its own."""
    seen, out = {}, []
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            seen.setdefault(b[p : p + span], set()).add((n, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if len(seen[b[p : p + span]]) > 1:
                gone[p : p + span] = True
        out.append((i, len(b), int(gone.sum()), len(repeats.runs(gone)[0]), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, span):
    least, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i, p: (-(1 << 63) if i is None else i, p)
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - span + 1):
            v = tuple(w[p : p + span])
            least[v] = min(least.get(v, key(i, p)), key(i, p))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - span + 1):
            if least[tuple(w[p : p + span])] < key(i, p):
                gone[p : p + span] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    docs = []
    for _ in range(80):
        if docs and rng.random() < 0.5:
            w = list(rng.choice(docs))
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(base)
            at = rng.randint(0, max(0, len(w) // 2))
            docs.append(w[at : at + rng.randint(5, 200)])
        else:
            docs.append([rng.choice(base) for _ in range(rng.randint(0, 150))])
    out = [(i, " ".join(w)) for i, w in enumerate(docs)]
    out += [(500, None), (501, ""), (None, out[3][1]), (600, "a" * 700), (601, "ab" * 300 + "x" + "ab" * 100), (602, "the cat " * 80), (603, "z " * 50), (5, out[5][1])]
    own = " ".join("".join(rng.choice("defgh") for _ in range(5)) for _ in range(70))
    # Repeated rows, rows that share an id, null ids, a text that repeats itself at length.
    out += [(700, own), (700, own), (700, own), (701, own[:240] + " other"), (5, out[7][1]), (None, out[9][1]), (None, None), (-4, own[200:]), (702, "=" * 4000), (703, "y " * 900)]
    return out


@pytest.mark.parametrize("group_bytes", [1 << 18, 600, 0])
@pytest.mark.parametrize(("span", "grams"), [(200, (32, 80, 140, 200)), (40, (8, 20, 40))])
def test_bytes(spark, rows, span, grams, group_bytes):
    how = replace(suffix_dedup.BYTES, span=span, grams=grams, group_bytes=group_bytes)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int").repartition(3)
    out = suffix_dedup.remove_repeated_bytes(docs, how, keep_text=False)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_bytes(rows, span)


@pytest.mark.parametrize("group_bytes", [1 << 18, 400, 0])
@pytest.mark.parametrize(("span", "grams"), [(20, (5, 10, 15, 20)), (6, (2, 6))])
def test_words(spark, rows, span, grams, group_bytes):
    how = replace(substring_dedup.WORDS, span=span, grams=grams, group_bytes=group_bytes)
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, _id string, row int").repartition(3)
    out = substring_dedup.remove_repeated_words(docs, how)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()]
    assert sorted(got, key=str) == brute_words(rows, span)
    assert sorted((r.row.row, r.doc_id) for r in out.collect()) == [(i, r[0]) for i, r in enumerate(rows)]


def flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_corpus_order_is_the_order_of_suffixes():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 120))) for _ in range(12)] + [b"ab" * 90, b"a" * 70]
    rest, follow = suffix_dedup.corpus_order(*flat(texts))
    suffixes = [t[i:] for t in texts for i in range(len(t))]
    got = [suffixes[i] for i in np.lexsort((follow, rest))]
    # Up to the end of the shorter of two suffixes, which repeats doesn't reach.
    assert all(a[: min(len(a), len(b))] <= b[: min(len(a), len(b))] for a, b in zip(got, got[1:]))


def test_common_compares_bytes():
    rng = random.Random(4)
    body = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    for length in (3, 8, 13, 21):
        p, q = (np.array([rng.randrange(400 - length) for _ in range(3000)]) for _ in range(2))
        assert suffix_dedup.common(body, p, q, length).tolist() == [bytes(body[a : a + length]) == bytes(body[b : b + length]) for a, b in zip(p, q)]


def test_suffix_tree_has_the_deep_nodes():
    rng = random.Random(6)
    symbols = np.array([rng.randrange(2) for _ in range(300)], np.uint64)
    left = np.repeat([100, 200, 300], 100) - np.arange(300)
    suffixes = np.flatnonzero(left >= 8)
    leaf, node = substring_dedup.deep_nodes(*substring_dedup.suffix_tree(symbols, left, suffixes, 8), 8)
    got, want = {}, {}
    for i, n in zip(leaf, node):
        got.setdefault(n, set()).add(int(suffixes[i]))
    for i in suffixes:
        want.setdefault(tuple(symbols[i : i + 8]), set()).add(int(i))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_filter_of_documents_holds_none_back(spark):
    docs = spark.range(4000).selectExpr("id as _id", "xxhash64(id) as _th")
    some, others = repeats.Bloom(docs.where("_id % 40 = 3")).split(docs)
    got = {r._id for r in some.collect()}
    assert {i for i in range(4000) if i % 40 == 3} <= got and len(got) < 400 and others.count() == 4000 - len(got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert substring_dedup.remove_repeated_words(empty).count() == 0


def test_kept_text_keeps_its_lines(spark):
    line = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, line), (2, f"one\n{line}\ntwo three")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring_dedup.remove_repeated_words(docs).collect()}
    assert got == {1: line, 2: "one\ntwo three"}
