"""Phrase collocation mining, per language, by count tries.

Every shard (a task's rows) counts the phrases of its texts in tries of at most ``DEPTH`` words. A trie is written as
sorted runs of its paths; runs of all shards are dealt out by ranges of the paths and merged there, so a node gets its
count in the whole corpus however many shards and texts hold it, and a frequent first word is spread over many ranges.
The ranges' bounds are quantiles of the paths of some ``SAMPLE_ROWS`` rows; they settle who merges what, not what counts.

Tries grow in three passes over the texts: words, pairs of words, then phrases of three and four. No phrase is more
frequent than its parts, so a pass follows only parts that the pass before found often enough. It knows them by a
bitmap of ``BITMAP_WORDS`` * 8 bytes at most; beyond some ten million frequent nodes more paths pass it and are
counted for nothing, none is lost.

A node's left parts are those of its parent and the parent itself, one step up the trie; its right parts are those of
its suffix link (the path without its first word) and the link itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.text_arrays import Rolling, U, byte_symbols, bytes_of, mix
from rillflow.operators.tables import cut

DEPTH = 4
#: 64-bit words of the bitmap of frequent nodes.
BITMAP_WORDS = 1 << 20
#: Paths that a shard holds before it writes them as a run and starts anew.
RUN_PATHS = 7 << 17
#: Paths of a run that are written at once.
SLICE = 1 << 16
#: Rows whose paths bound the ranges, and paths of each of their runs.
SAMPLE_ROWS, SAMPLE_PATHS = 512, 512
#: Rows of an Arrow batch of texts: a text has kilobytes, and a task holds a batch several times.
BATCH_ROWS = 1000
#: Groups in which a language's phrases are ranked before the last ranking.
SALTS = 64
#: Bytes of text whose words are taken at once.
RANGE_BYTES = 1 << 18
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 32
_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
PATH = ["w1", "w2", "w3", "w4"]
#: The word after the last one of a short path: less than any, so that a path comes before those that go on.
NONE = -(1 << 63)
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Count = Callable[["_Words", np.ndarray, pa.Array], "_WordRun | _PathRun | None"]


def _parts(body: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end where a row or a piece ends: a phrase never crosses them, and a long text comes in several."""
    a = 0
    while a < len(body):
        b = min(a + limit, len(body))
        row = int(at[np.searchsorted(at, b)])
        while b < row:
            found = np.flatnonzero(_CUT[body[b - 1 : min(b - 1 + limit, row)]])
            if len(found):
                b += int(found[0])
                break
            b = min(b + limit, row)
        yield a, b
        a = b


class _Words:
    """The words of a range of bytes: ``symbols`` (64 bits of word and language), ``piece`` each, and where they lie."""

    def __init__(self, body: np.ndarray, edges: np.ndarray, langs: np.ndarray):
        stop = _CUT[body]
        ink = ~(stop | _GAP[body])
        edge = np.zeros(len(body), bool)
        edge[edges[edges < len(body)]] = True
        before, after = np.append(False, ink[:-1]) & ~edge, np.append(ink[1:], False)
        after[:-1] &= ~edge[1:]
        self.start, self.end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        self.row = np.searchsorted(edges, self.start, side="right") - 1
        self.piece = np.cumsum(stop | edge)[self.start]
        self.symbols = mix(Rolling(byte_symbols(body, lower=True)).of(self.start, self.end) ^ langs[self.row])


def _each(batches: Iterator[pa.RecordBatch], limit: int = RANGE_BYTES) -> Iterator[tuple[_Words, np.ndarray, pa.Array]]:
    """Words of the rows (lang, text), range by range, with the range's bytes and each row's language."""
    for batch in batches:
        body, at = bytes_of(batch.column(1))
        names = batch.column(0).dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(x or "") for x in names.dictionary.to_pylist()], np.uint64)
        langs = hashes[np.asarray(names.indices)] if len(hashes) else np.zeros(0, np.uint64)
        for a, b in _parts(body, at, limit):
            first, last = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b)
            yield _Words(body[a:b], np.maximum(at[first : last + 1] - a, 0), langs[first:last]), body[a:b], batch.column(0).slice(first, last - first)


def _heads(keys: list[np.ndarray]) -> np.ndarray:
    """Where a sorted sequence has a new key."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


class _WordRun:
    """Words (w1, lang, word, n) of a shard as a batch, sorted and each once when ``joined``."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.size = batch, batch.num_rows

    @classmethod
    def joined(cls, held: list[_WordRun]) -> _WordRun:
        both = pa.concat_batches([h.batch for h in held])
        key = np.asarray(both.column("w1"))
        order = np.argsort(key, kind="stable")
        heads = _heads([key[order]])
        n = np.add.reduceat(np.asarray(both.column("n"))[order], heads)
        both = both.take(pa.array(order[heads]))
        return cls(both.set_column(both.schema.get_field_index("n"), "n", pa.array(n, pa.int64())))

    def slices(self) -> Iterator[pa.RecordBatch]:
        yield self.batch


class _PathRun:
    """Paths of a shard's trie: numbers of words in ``names`` (sorted), a column for each place of the path, and counts. Half the bytes of the words themselves."""

    def __init__(self, names: np.ndarray, paths: list[np.ndarray], n: np.ndarray):
        self.names, self.paths, self.n, self.size = names, paths, n, len(n)

    @classmethod
    def joined(cls, held: list[_PathRun]) -> _PathRun:
        names = np.unique(np.concatenate([h.names for h in held]))
        moved = [np.searchsorted(names, h.names).astype(np.int32) for h in held]
        # -1 stands for no word, and comes first.
        paths = [np.concatenate([np.where(h.paths[d] < 0, np.int32(-1), m[h.paths[d]]) for h, m in zip(held, moved, strict=True)]) for d in range(len(held[0].paths))]
        n = np.concatenate([h.n for h in held])
        held.clear()
        pairs = [(a.astype(np.int64) << 32) + b for a, b in zip(paths[::2], paths[1::2], strict=True)]
        order = np.lexsort(pairs[::-1])
        heads = _heads([p[order] for p in pairs])
        del pairs
        first = order[heads]
        return cls(names, [p[first] for p in paths], np.add.reduceat(n[order], heads))

    def trimmed(self) -> _PathRun:
        """Without names that no path has."""
        used = np.zeros(len(self.names) + 1, bool)
        for p in self.paths:
            used[p] = True
        to = np.append(np.cumsum(used[:-1]) - 1, -1).astype(np.int32)
        return _PathRun(self.names[used[:-1]], [to[p] for p in self.paths], self.n)

    def slices(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, self.size, SLICE):
            words = [np.where(p[i : i + SLICE] < 0, NONE, self.names[p[i : i + SLICE]]) for p in self.paths]
            yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(self.n[i : i + SLICE])], names=[*PATH[: len(words)], "n"])


def _ranges(run: pa.RecordBatch, path: list[str], bounds: np.ndarray) -> np.ndarray:
    """The range of each path of a sorted run: how many of ``bounds`` (sorted paths) are not above it."""
    keys = [np.asarray(run.column(k)) for k in path]
    begins = np.empty(len(bounds), np.int64)
    for i, bound in enumerate(bounds):
        a, b = 0, run.num_rows
        for key, x in zip(keys[:-1], bound[:-1], strict=True):
            a, b = a + np.searchsorted(key[a:b], x, "left"), a + np.searchsorted(key[a:b], x, "right")
        begins[i] = a + np.searchsorted(keys[-1][a:b], bound[-1], "left")
    return np.searchsorted(begins, np.arange(run.num_rows), "right").astype(np.int32)


def _runs(count: Count, path: list[str], bounds: np.ndarray) -> Batches:
    """A shard's trie as sorted runs with their ``range``: ``count`` gives the paths of a range of words."""

    def ranged(held: list) -> Iterator[pa.RecordBatch]:
        for part in type(held[0]).joined(held).slices():
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_ranges(part, path, bounds))], names=[*part.schema.names, "range"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, body, langs in _each(batches):
            got = count(words, body, langs) if len(words.symbols) else None
            if got is None or not got.size:
                continue
            held.append(got)
            size += got.size
            if size > RUN_PATHS * 5 // 4:
                held = [type(got).joined(held)]
                size = held[0].size
                if size > RUN_PATHS:
                    yield from ranged(held)
                    held, size = [], 0
        if held:
            yield from ranged(held)

    return run


def _single(words: _Words, body: np.ndarray, langs: pa.Array) -> _WordRun:
    """Nodes of depth one: every word of a range, with its language and text."""
    symbols, first, n = np.unique(words.symbols, return_index=True, return_counts=True)
    start, size = words.start[first], words.end[first] - words.start[first]
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    text = body[take] + _UPPER[body[take]]
    word = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
    return _WordRun(pa.RecordBatch.from_arrays([pa.array(symbols.view(np.int64)), langs.take(pa.array(words.row[first])), word.cast(pa.string()), pa.array(n.astype(np.int64))], names=["w1", "lang", "word", "n"]))


def _bits(path: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A path's word in the bitmap, and its two bits there."""
    h = np.zeros(len(path[0]), np.uint64)
    for w in path:
        h = mix((h ^ w) + U(0x9E3779B97F4A7C15))
    return (h >> U(12)) % U(BITMAP_WORDS), (U(1) << (h & U(63))) | (U(1) << ((h >> U(6)) & U(63)))


def _deep(least: int, most: int, known: int, bitmap) -> Count:
    """Nodes of ``least`` to ``most`` words whose parts of ``known`` words are all in the bitmap."""

    def count(words: _Words, body: np.ndarray, langs: pa.Array) -> _PathRun | None:
        s, bits, size = words.symbols, bitmap.value, len(words.symbols) - known + 1
        if size <= 0:
            return None
        at, mask = _bits([s[i : i + size] for i in range(known)])
        fits = ((bits[at.astype(np.int64)] & mask) == mask) & (words.piece[:size] == words.piece[known - 1 :])
        names, symbol = np.unique(s.view(np.int64), return_inverse=True)
        # Level by level: a node is its parent's number and its last word, so nodes come sorted by path.
        begin = np.flatnonzero(fits)
        node, paths, out = symbol[begin], [np.arange(len(names), dtype=np.int32)], []
        for depth in range(2, most + 1):
            if depth > known:
                more = begin + depth - known
                on = (more < size) & fits[np.minimum(more, size - 1)] & (words.piece[begin] == words.piece[np.minimum(begin + depth - 1, len(s) - 1)])
                begin, node = begin[on], node[on]
            if not len(begin):
                break
            keys, node, n = np.unique((node.astype(np.int64) << 32) | symbol[begin + depth - 1], return_inverse=True, return_counts=True)
            paths = [p[keys >> 32] for p in paths] + [(keys & 0xFFFFFFFF).astype(np.int32)]
            if depth >= least:
                out.append(_PathRun(names, paths + [np.full(len(n), -1, np.int32)] * (most - depth), n.astype(np.int64)))
        return _PathRun.joined(out).trimmed() if out else None

    return count


def _merge(path: list[str], least: int) -> Batches:
    """Rows sorted by path to one row a path, where its counts add up to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.concat_batches([held, batch])
            heads = _heads([np.asarray(both.column(k)) for k in path])
            n = np.add.reduceat(np.asarray(both.column("n")), heads)
            both = both.take(pa.array(heads))
            both = both.set_column(both.schema.get_field_index("n"), "n", pa.array(n, pa.int64()))
            yield both.slice(0, len(n) - 1).filter(pa.array(n[:-1] >= least))
            held = both.slice(len(n) - 1)
        if held is not None:
            yield held.filter(pc.greater_equal(held.column("n"), least))

    return run


def _bounds(rows: DataFrame, count: Count, path: list[str], ranges: int) -> np.ndarray:
    """Paths that cut the corpus' paths into about equal ranges; at most ``SAMPLE_ROWS`` * ``SAMPLE_PATHS`` come to the driver, or so."""
    none = np.zeros((0, len(path)), np.int64)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(count, path, none)(batches):
            yield run.select(path).take(pa.array(np.arange(0, run.num_rows, -(-run.num_rows // SAMPLE_PATHS))))

    part = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    taken = rows.sample(part, seed=11).mapInArrow(thin, ", ".join(f"{w} bigint" for w in path)).toArrow()
    keys = [np.asarray(taken.column(k)) for k in path]
    order = np.lexsort(keys[::-1])
    at = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
    return np.unique(np.stack([k[at] for k in keys], 1), axis=0) if len(at) else none


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within pass ``BATCH_ROWS`` rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def merged(rows: DataFrame, count: Count, path: list[str], columns: str, least: int) -> DataFrame:
    """Tries of all shards, their sorted runs merged by ranges of their paths: nodes that occur ``least`` times in all. A table of ``columns``."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with _small_batches(rows.sparkSession):
        runs = rows.mapInArrow(_runs(count, path, _bounds(rows, count, path, ranges)), f"{columns}, range int")
        dealt = runs.repartitionById(ranges, "range").drop("range").sortWithinPartitions(*path)
        return cut(dealt.mapInArrow(_merge(path, least), columns), "nodes")


def bitmap(nodes: DataFrame, path: list[str]):
    """A broadcast of the bitmap of these nodes: ``BITMAP_WORDS`` words, whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_WORDS, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at, mask = _bits([np.asarray(batch.column(i)).view(np.uint64) for i in range(len(path))])
                np.bitwise_or.at(bits, at.astype(np.int64), mask)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    rows = nodes.select(*path).mapInArrow(mark, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[np.asarray(rows.column("at"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return nodes.sparkSession.sparkContext.broadcast(out)


def _linked(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` words with phrase, last word and the counts of their left and right parts, from those of one word less."""
    keys = PATH[:depth]
    parent = above.select(*PATH[: depth - 1], "lang", F.col("phrase").alias("front"), F.concat("lefts", F.array("a")).alias("lefts"))
    link = above.select(*[F.col(w).alias(v) for w, v in zip(PATH, PATH[1:depth], strict=False)], "last", F.concat(F.array("a"), "rights").alias("rights"))
    both = nodes.select(*keys, F.col("n").alias("a")).join(parent, PATH[: depth - 1]).join(link, PATH[1:depth])
    return cut(both.select(*keys, "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "a", "lefts", "rights"), "phrases")


def _candidates(level: DataFrame, longer: DataFrame | None, depth: int, percent: int) -> DataFrame:
    """Phrases of a level that no phrase of one word more covers. Any longer one that does has one between that does."""
    keys, wide = PATH[:depth], lambda c: F.col(c).cast("decimal(20,0)")
    if longer is not None:
        inside = longer.select(*keys, "a").unionAll(longer.select(*[F.col(w).alias(v) for w, v in zip(PATH[1 : depth + 1], keys, strict=True)], "a"))
        level = level.join(inside.groupBy(*keys).agg(F.max("a").alias("over")), keys, "left").where(F.col("over").isNull() | (wide("over") * 100 < wide("a") * percent))
    return level.select("lang", "phrase", "a", "lefts", "rights")


def _score() -> Column:
    """The lowest-scoring cut of a phrase: (score, k, l, r)."""
    return F.expr(
        "array_min(transform(sequence(0, size(lefts) - 1), k -> struct("
        "(cast(a as decimal(20,0)) * 2000000bd) div (cast(lefts[k] as decimal(20,0)) + cast(rights[k] as decimal(20,0))) as score, k, lefts[k] as l, rights[k] as r)))"
    )


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language of ``docs(lang, text)``.

    Texts (null: empty) are lower-cased A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words
    ``[^\\x20\\x09]+``; a null language is ``und``. Candidates are phrases of 2 to 4 words that occur ``a`` >= ``least``
    times within pieces of their language. A cut after k words has ``l`` and ``r``, the counts of the two parts, and scores
    floor(2000000 * a / (l + r)); the lowest-scoring cut counts, ties to the smallest k. A candidate inside a longer one
    of ``percent`` of its count or more is dropped. Phrases rank by score and ``a`` (descending), then by their bytes.
    ``n`` counts all words of the language. Repeated rows count again; rows without words add nothing, and a language
    without candidates gives no row; other columns of ``docs`` are ignored. Words are known by 64-bit hashes.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = merged(rows, _single, PATH[:1], "w1 bigint, lang string, word string, n bigint", 1)
    total = nodes.groupBy("lang").agg(F.sum("n").alias("n"))
    words = nodes.where(F.col("n") >= least)

    def grown(nodes: DataFrame, known: int, shortest: int, longest: int) -> DataFrame:
        path = PATH[:longest]
        return merged(rows, _deep(shortest, longest, known, bitmap(nodes, PATH[:known])), path, ", ".join(f"{w} bigint" for w in [*path, "n"]), least)

    pairs = grown(words, 1, 2, 2)
    deep = grown(pairs, 2, 3, DEPTH)
    none = F.array().cast("array<bigint>")
    one = words.select("w1", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), none.alias("lefts"), none.alias("rights"))
    levels, above = [], one
    for depth, nodes in ((2, pairs), (3, deep.where(F.col("w4") == NONE)), (4, deep.where(F.col("w4") != NONE))):
        above = _linked(nodes, above, depth)
        levels.append(above)
    found = [_candidates(level, longer, depth, percent) for depth, (level, longer) in enumerate(zip(levels, [*levels[1:], None], strict=True), 2)]
    found = found[0].unionAll(found[1]).unionAll(found[2]).withColumn("best", _score()).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
