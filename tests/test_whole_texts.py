"""Texts are judged as a whole, against brute force."""

import random
import unicodedata

from rillflow.functions import mathtext as mt
from rillflow.plans import catalog, text_queries  # noqa: F401


def brute_share(text):
    n, order = len(text), sorted(range(len(text)), key=lambda i: text[i:])
    total = 0
    for i, j in zip(order, order[1:], strict=False):
        while j < n and i < n and text[i] == text[j]:
            i, j, total = i + 1, j + 1, total + 1
    return 2 * total / (n * (n + 1)) if n > 1 else 0.0


def test_repeated_shares_equal_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "aa", "ab", "\0\0a\0", "é\U0001f600" * 9, "a" * 700, "ab" * 300 + "c"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for letters in ("a", "ab", "abcé中", "".join(map(chr, range(32, 1500)))) for _ in range(12)]
    once = "".join(rng.choice("abcdefgh") for _ in range(1500))
    texts += [once + once, once + "x" + once[:400]]
    want = [brute_share(t) for t in texts]
    for chunk in (1, 500, 1 << 18):
        assert all(abs(a - b) < 1e-12 for a, b in zip(mt.repeated_shares(texts, chunk), want, strict=True))


def test_math_repetition_reads_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    long = say(2000)
    texts = [say(400) + "é" + "xyz" * 1000, long * 3, say(3000) + "É", "ab" * 200 + say(4000), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in catalog.QUERIES["math_repetition"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert got[i].repetitive == (brute_share(t or "") > 0.2)
        assert got[i].plain == (None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
    assert [got[i].repetitive for i in range(4)] == [True, True, False, False]


def test_plain_answer_reads_whole_texts(spark, tmp_path):
    texts = ["x " * 40 + "The  end,\n\tof\n\n(an) answer: a-b é THE", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.answer for r in catalog.QUERIES["grade_plain_answer"](spark, str(tmp_path)).collect()}
    assert got == {0: "x " * 40 + "end of answer ab x", 1: None, 2: ""}


def test_code_traces_take_all_documents(spark, tmp_path):
    spark.createDataFrame([(i, "x") for i in range(8)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.passed for r in catalog.QUERIES["grade_code_traces"](spark, str(tmp_path)).collect()}
    assert got == {i: i % 4 / 4 for i in range(8)}
