"""Near-dedup of documents and of vectors against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import odd_sketches, tree_forest
from rillflow.llm.components import components


def sets_of(rows):
    out = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append(frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    sets, label = sets_of(rows), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                label[find(a)] = find(b)
    ids, least = [-1 if r[0] is None else r[0] for r in rows], {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), 1 << 60), ids[a])
    return sorted(((i, len(sets[a]), None if least[find(a)] < 0 else least[find(a)], least[find(a)] == ids[a]) for a, (i, _) in enumerate(rows)), key=str)


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    docs = []
    for _ in range(200):
        if docs and rng.random() < 0.6:
            w = list(rng.choice(docs))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(w)
        else:
            docs.append([rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 40, 80, 200]))])
    rows = [(i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)) for i, w in enumerate(docs)]
    rows += [(900, None), (901, ""), (None, rows[8][1]), (7, rows[5][1]), (3, rows[3][1])]
    made = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, c int").repartition(3)
    assert sorted((tuple(r) for r in odd_sketches.near_duplicates(made).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block", [256, 3])
def test_open_bands_meet_block_against_block(spark, monkeypatch, block):
    """A common passage puts unlike documents in one band; some of them are alike among themselves."""
    monkeypatch.setattr(odd_sketches, "BLOCK", block)
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    passage, docs = say(60), []
    for _ in range(14):
        own = passage + say(50)
        docs += [own, own[:-3] + say(3), own[:-8] + say(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = odd_sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows) and len({r.component_id for r in got}) < 40


def test_near_duplicates_of_odd_tables(spark):
    long = " ".join(f"w{i % 4001}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, None), (3, None), (4, "a b"), (5, "a b"), (6, "a b c")]
    made = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, kept int, component_id string")
    assert sorted(map(tuple, odd_sketches.near_duplicates(made).collect()), key=str) == brute(rows)
    assert odd_sketches.near_duplicates(made.limit(0)).count() == 0


def test_short_sketch_holds_pairs_at_the_bound():
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = np.sort(both[:875]), np.sort(both[125:])  # 750 of 1000
        _, _, odd = odd_sketches.signatures(np.concatenate([a, b]), np.array([0, 875, 1750]))
        lost += int(np.bitwise_count(odd[0] ^ odd[1]).sum()) > odd_sketches.most_bits()
    assert lost <= 1


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for shared in (300, 675, 800):
        a, b = np.sort(both[:shared]), both[:shared]
        rest = rng.integers(0, 1 << 63, 900 - shared, dtype=np.uint64)
        a = np.sort(both[: shared + (900 - shared) // 2])
        b = np.sort(np.concatenate([both[:shared], rest[: (900 - shared) // 2]]))
        similarity = shared / (len(a) + len(b) - shared)
        long = odd_sketches.long_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = int(np.unpackbits((long[0] ^ long[1]).view(np.uint8)).sum())
        low, high = (odd_sketches.most_bits(similarity + d, odd_sketches.LONG_SAMPLES, odd_sketches.LONG_BITS) for d in (0.08, -0.08))
        assert low <= bits <= high


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    label = {x: x for e in links for x in e}
    for _ in range(500):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and all(label[x] == x for x in label if x not in got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_recall_and_rules(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 16))
    x[300:600] = x[:300] + 0.1 * r.normal(size=(300, 16))
    x[600:700] = x[5] + 0.15 * r.normal(size=(100, 16))
    x[700:720] = x[3]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    good = [*rows, (None, rows[3][1])]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, None]), (2005, [float("inf")] * 16)]
    df = spark.createDataFrame([(*v, 1) for v in good + bad], "vec_id long, embedding array<float>, c int").repartition(3)
    got = {g.vec_id: g for g in tree_forest.near_vectors(df, leaf_rows=64).collect()}
    y = np.array([v for _, v in good])
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = (y @ y.T >= 0.9).sum(1) - 1
    found = [got[i].n_links for i, _ in good]
    assert sum(found) >= 0.9 * links.sum() and all(f <= n for f, n in zip(found, links, strict=True))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad)
    assert got[3].component_id is None and not got[3].kept and got[None].kept
    assert tree_forest.near_vectors(df.limit(0)).count() == 0


def recall(y, got, query):
    """Share of each query vector's links that it has, averaged over the query vectors that have any."""
    shares = []
    for i in query:
        links = int((y @ y[i] >= 0.9).sum()) - 1
        assert got[i] <= links
        if links:
            shares.append(got[i] / links)
    return sum(shares) / len(shares), len(shares)


def planted(n, seed):
    """Vectors of 64 dimensions, half of them with a partner at cosine 0.9 to 0.97."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    half = n // 2
    cosine, side = r.uniform(0.901, 0.97, half)[:, None], r.normal(size=(half, 64))
    side -= (side * x[:half]).sum(1)[:, None] * x[:half]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x[half : 2 * half] = cosine * x[:half] + np.sqrt(1 - cosine**2) * side
    return x.astype(np.float32)


def test_recall_per_vector(spark):
    """Ids divisible by 20 against all rows, with the parameters of production."""
    n = 12_000
    x = planted(n, 5)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": lists})).repartition(4)
    got = {r.vec_id: r.n_links for r in tree_forest.near_vectors(df).select("vec_id", "n_links").collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    share, many = recall(y, got, range(0, n, 20))
    assert many > 500 and share >= 0.9


def test_recall_beyond_the_fitted_leaves():
    """Over 2**12 leaves a tree, with levels below the fitted ones: partners that share a leaf."""
    x = planted(12_000, 13).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = tree_forest.fit(x, 12_000, 0.9, None, 2, 0.1, 0.97, 11)
    assert forest.deeper == 2
    row, leaf = forest.leaves(x)
    order = np.lexsort((leaf, row))
    each = np.split(leaf[order], np.cumsum(np.bincount(row, minlength=12_000))[:-1])
    met = [len(np.intersect1d(each[i], each[i + 6000])) > 0 for i in range(0, 6000, 20)]
    assert sum(met) >= 0.9 * len(met)


def test_copies_grow_slowly():
    """Leaves a vector: with 600 times the rows some five times as many."""
    r = np.random.default_rng(3)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies = []
    for rows in (50_000, 30_000_000):
        forest = tree_forest.fit(x, rows, 0.9, None, 512, 0.1, 0.97, 1)
        copies.append(len(forest.leaves(x[:1000])[0]) / 1000)
    assert copies[0] < 14 and copies[1] < 7 * copies[0]


@pytest.mark.parametrize("rows", [3000])
def test_large_leaves_meet_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(tree_forest, "BLOCK", 500)
    r = np.random.default_rng(8)
    x = np.ones((rows, 8)) + 0.02 * r.normal(size=(rows, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = tree_forest.near_vectors(df, trees=2, leaf_rows=4096).selectExpr("min(n_links)", "max(n_links)", "max(component_id)").first()
    assert tuple(got) == (rows - 1, rows - 1, 0)
