"""The pipeline against the operators' brute-force versions, stage by stage, on a small fixture."""

import random

import corpus_pipeline
from tests.llm.test_repeats import brute_words
from tests.llm.test_similarity import brute
from tests.llm.test_texts import check_packing


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, docs = say(60), []
    for i in range(60):
        w = say(rng.randint(80, 200))
        if i % 6 == 1:
            w = list(docs[i - 1][1])
            w[3] = "changed"
        if i % 6 == 3:
            w[20:20] = passage
        docs.append((i, w))
    rows = [(i, " ".join(w), "en", f"s{i % 3}", 0) for i, w in docs]
    rows += [(100, "too short", "en", "s1", 9), (101, None, "en", None, None), (102, " ".join(say(90)) + " secret=" + "k" * 16, "en", "s1", 0), (103, "### " * 90, "en", "s1", 0)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    docs_now, kept = made, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == made.columns
        kept.append(sorted((r.doc_id, r.text) for r in docs_now.collect()))
    quality, near, substring, secrets = kept
    assert {i for i, _ in quality} == {*range(60), 102}
    assert [i for i, _ in near] == [i for i, _, _, stays in sorted(brute(quality)) if stays]
    removed = {i: n for i, _, n, _ in brute_words(near, 20)}
    assert {i for i, t in substring} == {i for i, t in near} and sum(removed.values()) > 0
    assert all(len(dict(near)[i].split()) - len(t.split()) == removed[i] for i, t in substring)
    assert dict(secrets)[102].endswith("[SECRET]") and all(t == dict(substring)[i] for i, t in secrets if i != 102)
    out = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert check_packing(out, secrets) < 0.1


def test_shared_and_null_ids_stay_whole(spark, tmp_path):
    rng = random.Random(10)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    clean = [(None, say(90)) for _ in range(6)] + [(5, say(90) + " secret=" + "k" * 16), (5, say(90)), (5, say(120))]
    near = (None, clean[0][1] + " changed")
    rows = [(*r, "en", "s1", 0) for r in [*clean, near, clean[1], clean[1], clean[6]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    order = lambda pairs: sorted(pairs, key=str)
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, str(tmp_path))
    kept = order((r.doc_id, r.text) for r in docs.collect())
    assert kept in (order(clean), order([near, *clean[1:]]))
    # One copy more of a passage, under another id, for the substring stage.
    docs = docs.unionByName(spark.createDataFrame([(9, clean[7][1] + " " + say(60), "en", "s1", 0)], docs.schema))
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[2:4]:
        docs = stage(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(before) == 10
    want = {(i, t.replace("secret=" + "k" * 16, "[SECRET]")) for i, t in before if i != 9}
    assert {x for x in got if x[0] != 9} == want and [len(t.split()) for i, t in got if i == 9] == [60]


def test_columns_of_any_name_stay(spark, tmp_path):
    """Names that stages use themselves, in the user's table."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    more = ("_th", "_id", "_doc", "_text", "_z", "row", "first", "n", "kept", "spans", "found", "repository", "owner", "n_words", "text_hash", "c", "component_id", "_word", "_bits", "odd name", "base_failed")
    texts = [say(90) for _ in range(8)]
    texts += [texts[0], texts[1] + " changed", texts[2] + " secret=" + "k" * 16]
    rows = [(i, t, "en", "s1", len(t), *[f"{m}{i}" for m in more]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{m}` string" for m in more)).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        got = made.collect()
        assert all(r[m] == f"{m}{r.doc_id}" for r in got for m in more)
        docs = spark.createDataFrame(got, docs.schema)
    assert {r.doc_id for r in got} == set(range(8))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 8


def test_an_empty_table_gives_none(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
