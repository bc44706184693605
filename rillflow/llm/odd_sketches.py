"""MinHash near-dedup with odd sketches.

Documents with one set of word shingles are one class; classes are compared, not their copies. A class has
``BANDS * ROWS`` MinHash samples, cut into bands, and an odd sketch: every sample flips one of ``BITS`` parity bits,
so the XOR of two sketches has as many bits as the samples differ (less what cancels), which estimates a high
similarity closely from a population count.

Classes that share a band meet there at a pivot, the least class of the band; pairs whose sketches allow the
similarity are confirmed on the full sets and linked. Bands whose members are then still in several components go on:
members outside the band's largest component meet all members of other components, by both odd sketches, then by set.
They meet block against block: a band of any size is spread over tasks in groups of two blocks of some ``BLOCK`` sketches,
which return only the pairs that both sketches allow. A pivot's confirmations are spread over salted groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.components import components
from rillflow.llm.text_arrays import Rolling, U, chunks, grouped, mix, seeded, word_symbols, words
from rillflow.operators.tables import cut

SHINGLE, BANDS, ROWS, BITS = 5, 32, 4, 512
NULL_ID = -(1 << 63)
#: Similarity below which a sketch rules a pair out: 4 standard errors of 128 samples below 0.75.
SKETCH_LEAST = 0.57
#: A longer sketch, of documents in open bands only: 1024 samples in 4096 bits err by 0.0185, and 0.68 is 3.8 times that below 0.75.
LONG_SAMPLES, LONG_BITS, LONG_LEAST = 1024, 4096, 0.68
#: Members that one salted group of a pivot confirms.
GROUP = 64
#: Members of a band in one block: two of them meet in a task.
BLOCK = 256
_FACTORS = seeded(BANDS * ROWS, 505) | U(1)
_LONG_FACTORS = seeded(LONG_SAMPLES, 90_210) | U(1)


def most_bits(least: float = SKETCH_LEAST, samples: int = BANDS * ROWS, bits: int = BITS) -> int:
    """Differing bits that a pair of that similarity is expected to have."""
    return int(bits / 2 * (1 - np.exp(-2 * (2 * samples * (1 - least)) / bits)))


def shingle_sets(body: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending, and where each row's begin."""
    begin, end, first = words(body, at)
    symbols = word_symbols(body, begin, end, lower=True)
    rolling = Rolling(symbols)
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    row, place = grouped(many)
    start = first[row] + place
    hashes = rolling.of(start, np.minimum(start + size, first[row + 1])) if len(row) else np.zeros(0, np.uint64)
    upto = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[upto]


def _sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    total = np.concatenate([[U(0)], np.cumsum(values, dtype=np.uint64)])
    return total[upto[1:]] - total[upto[:-1]]


def signatures(hashes: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, bands (rows x BANDS) and odd sketch (rows x BITS / 64) of sets that aren't empty."""
    rows = len(upto) - 1
    name = mix(_sums(mix(hashes ^ U(0xA5A5A5A5)), upto) ^ mix(_sums(mix(hashes * U(0x9E3779B97F4A7C15)), upto)) ^ np.diff(upto).astype(np.uint64))
    least = np.empty((BANDS * ROWS, rows), np.uint64)
    turned = np.empty_like(hashes)
    for i, factor in enumerate(_FACTORS):
        np.multiply(hashes, factor, out=turned)
        least[i] = np.minimum.reduceat(turned, upto[:-1])
    bands = np.zeros((rows, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(rows, b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ least[b * ROWS + r]) + U(r)
        bands[:, b] = key
    odd = np.zeros((rows, BITS), np.uint8)
    for i in range(BANDS * ROWS):
        _flip(odd, least[i], i)
    return name, bands, np.packbits(odd, axis=1).view(np.uint64)


def _flip(odd: np.ndarray, sample: np.ndarray, i: int) -> None:
    """The ``i``-th sample of each row flips the bit that it hashes to."""
    odd[np.arange(len(odd)), (mix(sample + U(i * 7919 + 1)) % U(odd.shape[1])).astype(np.int64)] ^= 1


def long_sketches(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Odd sketches (rows x LONG_BITS / 64) of sets that aren't empty."""
    odd, turned = np.zeros((len(upto) - 1, LONG_BITS), np.uint8), np.empty_like(hashes)
    for i, factor in enumerate(_LONG_FACTORS):
        np.multiply(hashes, factor, out=turned)
        _flip(odd, np.minimum.reduceat(turned, upto[:-1]), i)
    return np.packbits(odd, axis=1).view(np.uint64)


def _sign_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, body, at in chunks(batches, "_text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(long_sketches(*shingle_sets(body, at)))], names=["c", "long"])


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, body, at in chunks(batches, "_text"):
        hashes, upto = shingle_sets(body, at)
        n = np.diff(upto)
        full = np.flatnonzero(n > 0)
        name, bands, odd = np.zeros(len(n), np.uint64), np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), BITS // 64), np.uint64)
        if len(full):
            name[full], bands[full], odd[full] = signatures(hashes, np.append(upto[:-1][full], upto[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(name.view(np.int64), mask=n == 0), _lists(bands), _lists(odd)], names=["_id", "_th", "n", "c", "bands", "odd"]
        )


def _confirm(percent: int):
    """Rows sorted by (pivot, salt, member): the pivot's text first, then its members' texts; yields the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base = None, np.zeros(0, np.uint64)
        for batch, body, at in chunks(batches, "_text"):
            hashes, upto = shingle_sets(body, at)
            u, v = [], []
            pivots, salts, members, ids = (batch.column(i).to_pylist() for i in range(4))
            for i, key in enumerate(zip(pivots, salts, strict=True)):
                mine = hashes[upto[i] : upto[i + 1]]
                if not members[i]:
                    group, base = key, mine
                elif key == group:
                    both = np.concatenate([base, mine])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(base) + len(mine) - shared):
                        u.append(ids[i])
                        v.append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """(u, v) of the ``pairs(c, pivot)`` of classes whose full sets are similar enough. ``texts(c, _text)``: one of each class."""
    sized = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    spread = pairs.join(sized, "pivot").withColumn("salt", F.expr("cast(pmod(xxhash64(c, pivot), salts) as int)"))
    members = spread.select("pivot", "salt", F.lit(1).alias("member"), "c")
    heads = sized.select("pivot", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("member"), F.col("pivot").alias("c"))
    rows = members.unionAll(heads).join(texts, "c").select("pivot", "salt", "member", "c", "_text")
    return rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member").mapInArrow(_confirm(percent), "u bigint, v bigint")


def _allowed(a: str, b: str, bits: int = BITS, most: int = most_bits()) -> str:
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(bits // 64)) + f" <= {most}"


def _words(column: pa.Array) -> np.ndarray:
    """Rows x words of a column of sketches."""
    return np.asarray(column.flatten()).view(np.uint64).reshape(len(column), -1)


def _near(sketches: np.ndarray, u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Which pairs differ in ``most`` bits at most; a few MB of sketches at a time."""
    step = max(1, (1 << 19) // sketches.shape[1])
    parts = [np.bitwise_count(sketches[u[i : i + step]] ^ sketches[v[i : i + step]]).sum(1, dtype=np.int64) <= most for i in range(0, len(u), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, bi, bj, side, c, component, odd, long, bands) sorted by the first three, two blocks of a band each, to the
    pairs of several components that both sketches allow, each in the first band that it shares."""
    held: list[pa.RecordBatch] = []

    def pairs(batch: pa.RecordBatch, edges: list[int]) -> pa.RecordBatch:
        bi, bj, side, c, component = (np.asarray(batch.column(i)) for i in range(1, 6))
        odd, long, bands = (_words(batch.column(i)) for i in (6, 7, 8))
        band = np.asarray(batch.column(0)).view(np.uint64)
        left, right = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if bi[a] == bj[a]:
                u, v = np.triu_indices(b - a, 1)
                u, v = u + a, v + a
            else:
                u, v = (x.ravel() for x in np.meshgrid(a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1), indexing="ij"))
            apart = component[u] != component[v]
            left.append(u[apart]), right.append(v[apart])
        u, v = np.concatenate(left), np.concatenate(right)
        fits = _near(odd, u, v, most_bits())
        u, v = u[fits], v[fits]
        fits = _near(long, u, v, most_bits(LONG_LEAST, LONG_SAMPLES, LONG_BITS))
        u, v = u[fits], v[fits]
        fits = bands[u, (bands[u] == bands[v]).argmax(1)] == band[u]
        return pa.RecordBatch.from_arrays([pa.array(c[u[fits]], pa.int64()), pa.array(c[v[fits]], pa.int64())], names=["c", "pivot"])

    def groups(batch: pa.RecordBatch) -> np.ndarray:
        keys = [np.asarray(batch.column(i)) for i in range(3)]
        return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))

    def whole(batch: pa.RecordBatch, heads: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        edges = [*heads.tolist(), end]
        # Some 2**18 pairs at once, or one group of more.
        i = 0
        while i < len(edges) - 1:
            j, size = i + 1, (edges[i + 1] - edges[i]) ** 2
            while j < len(edges) - 1 and size < 1 << 18:
                size, j = size + (edges[j + 1] - edges[j]) ** 2, j + 1
            yield pairs(batch, edges[i : j + 1])
            i = j

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        both = pa.concat_batches(held) if len(held) > 1 else batch
        heads = groups(both)
        if len(heads) > 1:
            yield from whole(both, heads[:-1], int(heads[-1]))
            both = both.slice(int(heads[-1]))
        held = [both]
    if held:
        yield from whole(held[0], np.array([0]), held[0].num_rows)


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Links join documents with 100 * intersection >= ``percent`` * union of their shingle sets: 5 words each, A-Z
    lower-cased, or the whole sequence of fewer words. Documents without words link with nothing. Repeated rows give
    repeated results; a null doc_id counts as the least id and comes back null, also as a component. An empty table
    gives none; other columns are ignored. ``hashed`` adds ``text_hash`` and ``first``: of near copies that share the
    least doc_id, only the text of least hash is first, and of repeated rows all. Bands of 4 samples miss a pair of similarity 0.75 with probability 5e-6,
    a sketch with 1e-4, more similar ones with far less.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(body).alias("_th"), body.alias("_text"))
    signed = cut(keyed.mapInArrow(_sign, "_id bigint, _th bigint, n bigint, c bigint, bands array<bigint>, odd array<bigint>"), "signatures")
    full = signed.where("c is not null")
    classes = cut(full.groupBy("c").agg(F.min(F.struct("_id", "_th")).alias("rep"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")
    bands = classes.select("c", F.explode("bands").alias("band"))
    met = bands.groupBy("band").agg(F.min("c").alias("pivot"), F.max("c").alias("last")).where("pivot != last").drop("last")
    shared = cut(bands.join(met, "band"), "bands")
    sketch, both = classes.select("c", "odd"), classes.select("c", "odd", "bands")
    first = shared.where("c != pivot").select("c", "pivot").distinct()
    first = first.join(sketch, "c").join(sketch.select(F.col("c").alias("pivot"), F.col("odd").alias("podd")), "pivot")
    first = cut(first.where(_allowed("odd", "podd")).select("c", "pivot"), "pairs")

    def texts(pairs: DataFrame) -> DataFrame:
        need = pairs.select("c").unionAll(pairs.select(F.col("pivot").alias("c"))).distinct()
        reps = classes.join(need, "c").select("c", F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th"))
        return keyed.join(reps, ["_id", "_th"]).select("c", "_text")

    links = cut(confirmed(first, texts(first), percent), "links")
    parts = components(links)
    # Bands whose members are in several components.
    member = shared.select("band", "c").join(parts.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    sizes = member.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("band").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", F.col("top.component").alias("top"))
    open_ = cut(member.join(top, "band").join(both, "c"), "open")
    longer = texts(open_.select("c", F.col("c").alias("pivot"))).mapInArrow(_sign_long, "c bigint, long array<bigint>").groupBy("c").agg(F.first("long").alias("long"))
    open_ = cut(open_.join(longer, "c").withColumn("rest", F.col("component") != F.col("top")), "open")
    # Blocks of each band: members outside its largest component meet each other, and those inside it.
    ranked = F.pmod(F.xxhash64("c", "band"), F.col("blocks")).cast("int")
    many = open_.groupBy("band").agg(F.ceil(F.count_if("rest") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("rest")) / BLOCK).cast("int").alias("inner"))
    member = open_.join(many, "band")
    rest = member.where("rest").withColumn("block", ranked)
    inner = member.where("not rest").withColumn("block", F.pmod(F.xxhash64("c", "band"), F.col("inner")).cast("int"))
    sides = "band", "bi", "bj", "side", "c", "component", "odd", "long", "bands"
    one = rest.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), F.when(F.col("block") <= F.col("o"), 0).otherwise(1).alias("side"), *sides[4:])
    two = rest.withColumn("o", F.explode(F.expr("if(inner > 0, sequence(0, inner - 1), array())"))).select("band", F.col("block").alias("bi"), (-1 - F.col("o")).alias("bj"), F.lit(0).alias("side"), *sides[4:])
    three = inner.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", F.col("o").alias("bi"), (-1 - F.col("block")).alias("bj"), F.lit(1).alias("side"), *sides[4:])
    dealt = one.unionAll(two).unionAll(three).repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    again = dealt.mapInArrow(_meet, "c bigint, pivot bigint")
    again = again.select(F.greatest("c", "pivot").alias("c"), F.least("c", "pivot").alias("pivot")).distinct()
    again = cut(again.join(first.select(F.greatest("c", "pivot").alias("c"), F.least("c", "pivot").alias("pivot")), ["c", "pivot"], "left_anti"), "pairs")
    if not again.isEmpty():
        links = cut(links.unionAll(confirmed(again, texts(again), percent)), "links")
        parts = components(links)
    named = classes.select("c", F.col("rep").alias("least")).join(parts.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    known = named.select("c", "component").join(least, "component").select("c", "least")
    out = signed.select("_id", "_th", "n", "c").join(known, "c", "left").withColumn("rep", F.coalesce("least", F.struct("_id", "_th"))).withColumn("least", F.col("rep._id"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    more = [F.col("_th").alias("text_hash"), (F.struct("_id", "_th") == F.col("rep")).alias("first")] if hashed else []
    return out.select(null("_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("least").alias("component_id"), (F.col("_id") == F.col("least")).alias("kept"), *more)
