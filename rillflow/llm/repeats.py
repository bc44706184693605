"""Which places of a corpus repeat a window of ``span`` symbols: what substring dedup by bytes and by words share.

The corpus is parsed into phrases. The trigger of a window is the least rolling hash among its grams, so every window
has one, and equal windows have equal triggers. Neighbouring windows of one trigger form a phrase (about two in every
``span - gram + 1`` symbols); phrases overlap by ``span - 1`` symbols, so each window lies in exactly one phrase.

1. Triggers are counted, eight bytes each. What a trigger that occurs once covers has no repeat: nearly all of a corpus.
2. Phrases of the other triggers are the parse. Its distinct phrases, with their number of places and the first one,
   are the dictionary. A phrase in several places repeats as a whole; a group of copies is a count, never a list.
3. Where a trigger has several phrases, or occurs in one twice, the text of each phrase goes once to a solver, which
   orders all suffixes of a trigger's phrases. A trigger whose phrases exceed ``group_bytes`` is lengthened first: its
   phrases are parsed again by the next longer gram, and again, up to a whole window.

Texts move only for documents that a Bloom filter of at most 4 MB doesn't rule out. Keys are ``doc_id`` (null: the
least id) with a hash of the text; rows with both equal are counted as places of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.text_arrays import CHUNK_BYTES, Rolling, U, byte_symbols, chunks, mix, word_symbols, words
from rillflow.operators.tables import cut

NULL_ID = -(1 << 63)
#: Bytes of phrases that a solver takes at once, beyond which it starts a new group of triggers.
BAG_BYTES = 1 << 20
#: 64-bit words of the Bloom filter over documents, at most.
BLOOM_WORDS = 1 << 19


@dataclass(frozen=True)
class Repeats:
    """``by``: "bytes" or "words". ``first``: whether the earliest place (least doc_id, then start) of a window stays.
    ``grams``: lengths of the triggers, shortest first; the last one is ``span``."""

    by: str
    span: int
    grams: tuple[int, ...]
    first: bool
    group_bytes: int = 1 << 18

    def symbols(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, where each row's begin, and the start and end byte of each."""
        if self.by == "bytes":
            place = np.arange(len(body))
            return byte_symbols(body), at, place, place + 1
        starts, ends, first = words(body, at)
        return word_symbols(body, starts, ends), first, starts, ends


def _slide(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """The least (or largest) of every ``width`` neighbours."""
    pick, step, out = (np.minimum if least else np.maximum), 1, values
    while 2 * step <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(symbols: np.ndarray, first: np.ndarray, how: Repeats, level: int = 0) -> dict[str, np.ndarray]:
    """Phrases of all rows: row, start and end (symbols, end exclusive, from the row's start), seed (the trigger), piece
    (content hash) and self (whether the trigger occurs in it twice). At the last level each window is a phrase."""
    span, gram = how.span, how.grams[level]
    width, n = span - gram + 1, len(symbols)
    if n < span:
        z = np.zeros(0, np.int64)
        return {k: z for k in ("row", "start", "end", "seed", "piece", "self")}
    rolling = Rolling(symbols)
    grams = rolling.grams(gram)
    seeds = _slide(grams, width)
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row_of[: n - span + 1] == row_of[span - 1 :]  # the window lies in one row
    change = np.ones(len(seeds), bool)
    if width > 1:
        change[1:] = (seeds[1:] != seeds[:-1]) | (row_of[1 : len(seeds)] != row_of[: len(seeds) - 1])
    heads = np.flatnonzero(change)
    tails = np.append(heads[1:], len(seeds)) - 1
    # Only windows that lie in one row count; in a row they are a prefix of its places.
    good = inside[heads]
    heads, tails = heads[good], tails[good]
    tails = np.minimum(tails, first[1:][row_of[heads]] - span)
    row, seed = row_of[heads], seeds[heads]
    ends = tails + span
    piece = rolling.of(heads, ends) ^ (ends - heads).astype(np.uint64)
    double = np.zeros(len(heads), bool)
    if width > 1:
        # Where grams are the trigger of a window over them; two of them with one hash and nothing smaller between share a phrase.
        padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, seeds, U(0)), np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_slide(padded, width, least=False)[: len(grams)] == grams)
        same = np.zeros(len(chosen) + 1, np.int64)
        if len(chosen) > 1:
            same[2:] = np.cumsum(grams[chosen[1:]] == grams[chosen[:-1]])
        lo, hi = np.searchsorted(chosen, heads), np.searchsorted(chosen, ends - gram, side="right")
        double = same[hi] - same[np.minimum(lo + 1, hi)] > 0
    begin = first[row]
    return {"row": row, "start": heads - begin, "end": ends - begin, "seed": seed.view(np.int64), "piece": piece.view(np.int64), "self": double.astype(np.int64)}


def keys(text: str = "text") -> list[Column]:
    """``_id`` and ``_th`` of a row."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_id, _th, _text) of every row."""
    return docs.select(*keys(text), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``_text`` compressed as ``_z``: texts go through a shuffle in half the bytes when compressed one by one."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        texts = pa.array([press.compress(x.as_buffer()) for x in batch.column(at).cast(pa.large_binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns)], names=["_z" if n == "_text" else n for n in batch.schema.names])


def squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_text`` as ``_z``."""
    return rows.mapInArrow(squeeze, T.StructType([f if f.name != "_text" else T.StructField("_z", T.BinaryType()) for f in rows.schema]))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``_z`` as ``_text`` again, a few MB at a time."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("_z")
        names = [n if n != "_z" else "_text" for n in batch.schema.names]
        i, size, texts = 0, 0, []
        for j, z in enumerate(batch.column(at)):
            texts.append(press.decompress(z.as_buffer()))
            size += len(texts[-1])
            if size > CHUNK_BYTES or j == batch.num_rows - 1:
                part = batch.slice(i, j + 1 - i)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary()) if k == at else part.column(k) for k in range(part.num_columns)], names=names)
                i, size, texts = j + 1, 0, []


class Bloom:
    """Documents that may be among ``keys(_id, _th)``: a filter of one 64-bit word a block, two bits a key, by broadcast join.

    It has four keys a word while they fit in ``BLOOM_WORDS``, and lets more others through beyond that; it never holds back one of ``keys``.
    """

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.words = min(BLOOM_WORDS, n // 4 + 1)
        bits = keys.select(self._word().alias("_word"), self._mask().alias("_bits"))
        self.table = F.broadcast(bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))

    def _word(self) -> Column:
        return F.pmod(F.xxhash64("_id", "_th"), F.lit(self.words)).cast("int")

    def _mask(self) -> Column:
        two = F.xxhash64("_th", "_id")
        bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(two, by).bitwiseAND(F.lit(63)).cast("int"))
        return bit(0).bitwiseOR(bit(6))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that may be among the keys, and all others."""
        columns = rows.columns
        joined = rows.withColumn("_word", self._word()).withColumn("_mask", self._mask()).join(self.table, "_word", "left")
        hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        return joined.where(hit).select(*columns), joined.where(~hit).select(*columns)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _triggers(how: Repeats) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, at in chunks(batches, "_text"):
            symbols, first, _, _ = how.symbols(body, at)
            found = phrases(symbols, first, how)
            seeds, which, counts = np.unique(found["seed"], return_inverse=True, return_counts=True)
            counts += np.bincount(which, found["self"], len(seeds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(np.minimum(counts, 2).astype(np.int32))], names=["seed", "n"])

    return run


_PHRASE = "_id bigint, _th bigint, seed bigint, piece bigint, start int, end int, size int, self int"


def _find(how: Repeats) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in chunks(batches, "_text"):
            symbols, first, begin, end = how.symbols(body, at)
            found = phrases(symbols, first, how)
            if not len(found["row"]):
                continue
            row, base = pa.array(found["row"]), first[found["row"]]
            size = end[base + found["end"] - 1] - begin[base + found["start"]]
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(found["seed"]), pa.array(found["piece"])]
            columns += [pa.array(x.astype(np.int32)) for x in (found["start"], found["end"], size, found["self"])]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_th", "seed", "piece", "start", "end", "size", "self"])

    return run


_ENTRY = "seed bigint, piece bigint, places bigint, id bigint, start bigint, rs bigint, rp bigint, off int, text binary"


def _slices(how: Repeats) -> Batches:
    """Rows (_id, _th, _text, wanted: array of seed, piece, places, start, end) to an entry with the text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in chunks(opened(batches), "_text"):
            _, first, begin, end = how.symbols(body, at)
            listed = batch.column(batch.schema.get_field_index("wanted"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(listed.offsets)))
            wanted = listed.flatten()
            start = np.asarray(wanted.field("start"))
            a, b = begin[first[row] + start], end[first[row] + np.asarray(wanted.field("end")) - 1]
            raw = body.tobytes()
            text = pa.array([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            seed, piece = wanted.field("seed"), wanted.field("piece")
            yield pa.RecordBatch.from_arrays(
                [seed, piece, wanted.field("places"), batch.column(batch.schema.get_field_index("_id")).take(pa.array(row)), pa.array(start.astype(np.int64)), seed, piece, pa.array(np.zeros(len(row), np.int32)), text],
                names=["seed", "piece", "places", "id", "start", "rs", "rp", "off", "text"],
            )

    return run


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _marked(flags: np.ndarray, many: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, start and end (symbols of its phrase at the first level) of each run of flagged windows; ``many`` windows an entry."""
    edges = np.zeros(len(flags) + 1, bool)
    edges[np.cumsum(many)] = True
    owner = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    head = flags & (np.append(True, ~flags[:-1]) | edges[:-1])
    tail = flags & (np.append(~flags[1:], True) | edges[1:])
    at = owner[head]
    return at, off[at] + place[head], off[at] + place[tail] + span


_MARK = "rs bigint, rp bigint, a int, b int"


def _mark_batch(bag: dict[str, np.ndarray], at: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bag["rs"][at]), pa.array(bag["rp"][at]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["rs", "rp", "a", "b"])


Solve = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], "Repeats"], np.ndarray]
_NUMBERS = ("seed", "piece", "places", "id", "start", "rs", "rp", "off")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Entries sorted by seed and piece, one of each piece, in groups of whole seeds of about ``BAG_BYTES``: numbers, bytes, offsets."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def bag() -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        one = table.column("text").chunk(0).cast(pa.large_binary())
        at = np.frombuffer(one.buffers()[1], np.int64)[one.offset : one.offset + len(one) + 1]
        body = np.frombuffer(one.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        return {k: table.column(k).to_numpy() for k in _NUMBERS}, body, at - at[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        seed, piece = (np.asarray(batch.column(k)) for k in (0, 1))
        fresh = np.ones(len(seed), bool)
        fresh[1:] = (seed[1:] != seed[:-1]) | (piece[1:] != piece[:-1])
        fresh[0] = (seed[0], piece[0]) != last
        new = np.flatnonzero(np.append(True, seed[1:] != seed[:-1])).tolist()
        for i, j in zip(new, [*new[1:], len(seed)], strict=True):
            if held and size > BAG_BYTES and (last is None or seed[i] != last[0]):
                yield bag()
                held, size = [], 0
            part = batch.slice(i, j - i)
            if not fresh[i:j].all():
                part = part.filter(pa.array(fresh[i:j]))
            if part.num_rows:
                held.append(part)
                size += part.column(8).nbytes
            last = (seed[j - 1], piece[j - 1])
    if held:
        yield bag()


def _solved(how: Repeats, solve: Solve) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bag, body, at in _bags(batches):
            _, first, _, _ = how.symbols(body, at)
            many = np.maximum(np.diff(first) - how.span + 1, 0)
            flags = solve(body, at, bag, how)
            if flags.any():
                yield _mark_batch(bag, *_marked(flags, many, bag["off"], how.span))

    return run


def _lengthened(how: Repeats, level: int) -> Batches:
    """Entries parsed again by a longer gram. A phrase that a chunk holds several times leaves it once, with the number of its places;
    what else that settles comes as rows without a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in chunks(batches, "text"):
            old = {k: np.asarray(batch.column(batch.schema.get_field_index(k))) for k in _NUMBERS}
            symbols, first, begin, end = how.symbols(body, at)
            found = phrases(symbols, first, how, level)
            row, start = found["row"], found["start"]
            seed = mix(old["seed"][row].view(np.uint64) ^ mix(found["seed"].view(np.uint64))).view(np.int64)
            order = np.lexsort((old["start"][row] + start, old["id"][row], found["piece"], seed))
            head = np.ones(len(order), bool)
            head[1:] = (seed[order[1:]] != seed[order[:-1]]) | (found["piece"][order[1:]] != found["piece"][order[:-1]])
            group = np.cumsum(head) - 1
            places = np.bincount(group, old["places"][row][order]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
            least = order[head]
            here = old["start"][row] + start
            if how.first:
                gone = (old["id"][row][order] != old["id"][row][least][group]) | (here[order] != here[least][group])
            else:
                gone = places[group] > 1
            settled = order[gone]
            flags = np.zeros(len(symbols) + 1, np.int64)  # windows of settled phrases, by their start
            np.add.at(flags, first[row[settled]] + start[settled], 1)
            np.add.at(flags, first[row[settled]] + found["end"][settled] - how.span + 1, -1)
            covered_, many = np.cumsum(flags[:-1]) > 0, np.diff(first)
            who, a, b = _marked(covered_, many, old["off"], how.span)
            base = first[row[least]] + start[least]
            x, y = begin[base], end[first[row[least]] + found["end"][least] - 1]
            raw = body.tobytes()
            text = [raw[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
            columns = {"seed": seed[least], "piece": found["piece"][least], "places": places, "id": old["id"][row[least]], "start": here[least], "rs": old["rs"][row[least]], "rp": old["rp"][row[least]], "off": (old["off"][row[least]] + start[least]).astype(np.int32)}
            yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in columns.values()], pa.array(text, pa.binary()), pa.array(found["self"][least].astype(np.int32)), pa.array((found["end"] - start)[least].astype(np.int32))], names=[*columns, "text", "self", "len"])
            if len(who):
                none = pa.nulls(len(who))
                fill = {"rs": pa.array(old["rs"][who]), "rp": pa.array(old["rp"][who]), "off": pa.array(a.astype(np.int32)), "len": pa.array((b - a).astype(np.int32))}
                schema = {"seed": pa.int64(), "piece": pa.int64(), "places": pa.int64(), "id": pa.int64(), "start": pa.int64(), "rs": pa.int64(), "rp": pa.int64(), "off": pa.int32(), "text": pa.binary(), "self": pa.int32(), "len": pa.int32()}
                yield pa.RecordBatch.from_arrays([fill.get(k, none.cast(t)) for k, t in schema.items()], names=list(schema))

    return run


def _marks(entries: DataFrame, how: Repeats, solve: Solve) -> DataFrame:
    """(rs, rp, a, b): repeated stretches of the dictionary's phrases. ``entries`` have ``hot``, whether their trigger's phrases exceed a group."""
    dealt = lambda rows: rows.select(*[c.split()[0] for c in _ENTRY.split(", ")]).repartition("seed").sortWithinPartitions("seed", "piece").mapInArrow(_solved(how, solve), _MARK)
    out, hot, level = dealt(entries.where("not hot")), entries.where("hot"), 0
    while not hot.isEmpty():
        level += 1
        parsed = cut(hot.drop("hot").mapInArrow(_lengthened(how, level), _ENTRY + ", self int, len int"), "phrases")
        out = out.unionAll(parsed.where("text is null").selectExpr("rs", "rp", "off as a", "off + len as b"))
        parsed = parsed.where("text is not null")
        place = F.struct("id", "start", "rs", "rp", "off")
        each = parsed.groupBy("seed", "piece").agg(F.sum("places").alias("all"), F.min(place).alias("lo"), F.max("self").alias("self"), F.max(F.length("text")).alias("size"))
        group = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max("self").alias("any"), F.sum("size").alias("bytes"))
        known = parsed.drop("self").join(each.drop("self", "size"), ["seed", "piece"])
        gone = F.expr("lo.id != id or lo.start != start") if how.first else F.expr("all > 1")
        out = out.unionAll(known.where(gone).selectExpr("rs", "rp", "off as a", "off + len as b"))
        if level == len(how.grams) - 1:
            break
        one = known.where(place == F.col("lo")).join(group.where("n > 1 or any > 0"), "seed")
        one = cut(one.select("seed", "piece", F.col("all").alias("places"), "id", "start", "rs", "rp", "off", "text", (F.col("bytes") > how.group_bytes).alias("hot")), "entries")
        out, hot = out.unionAll(dealt(one.where("not hot"))), one.where("hot")
    return out


def repeated_spans(docs: DataFrame, how: Repeats, solve: Solve, text: str = "text") -> DataFrame:
    """(_id, _th, spans: array of start, end in symbols) of every document with symbols to remove; spans may overlap. A table that is written."""
    rows = keyed(docs, text)
    shared = rows.mapInArrow(_triggers(how), "seed bigint, n int").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    places = cut(rows.mapInArrow(_find(how), _PHRASE).join(shared, "seed", "left_semi"), "parse")

    lo = F.min(F.struct("_id", "start", "_th", "end")).alias("lo")
    each = places.groupBy("seed", "piece").agg(F.count(F.lit(1)).alias("places"), lo, F.max("size").alias("size"), F.max("self").alias("self"))
    each = cut(each, "dictionary")
    group = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max("self").alias("any"), F.sum("size").alias("bytes")).where("n > 1 or any > 0")
    wanted = each.join(group, "seed").withColumn("hot", F.col("bytes") > how.group_bytes)
    asked = wanted.groupBy(F.col("lo._id").alias("_id"), F.col("lo._th").alias("_th")).agg(F.collect_list(F.struct("seed", "piece", "places", F.col("lo.start").alias("start"), F.col("lo.end").alias("end"))).alias("wanted"))
    asked = cut(asked, "asked")
    # Of rows with one id and text, one is read.
    texts = squeezed(Bloom(asked).split(rows)[0]).groupBy("_id", "_th").agg(F.first("_z").alias("_z")).join(asked, ["_id", "_th"])
    entries = texts.mapInArrow(_slices(how), _ENTRY)
    hot = group.where(F.col("bytes") > how.group_bytes).select("seed", F.lit(True).alias("hot"))
    if hot.isEmpty():
        entries = entries.withColumn("hot", F.lit(False))
    else:
        entries = cut(entries.join(hot, "seed", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "entries")
    marks = _marks(entries, how, solve).groupBy(F.col("rs").alias("seed"), F.col("rp").alias("piece")).agg(F.collect_set(F.struct("a", "b")).alias("marks"))
    judged = each.select("seed", "piece", "places", "lo").join(marks, ["seed", "piece"], "left").where("places > 1 or marks is not null")
    gone = F.expr("lo._id != _id or lo.start != start") if how.first else F.expr("places > 1")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("end") - F.col("start")).alias("b")))
    spans = places.join(judged, ["seed", "piece"]).select("_id", "_th", "start", F.explode(F.when(gone, whole).otherwise(F.col("marks"))).alias("m"))
    spans = spans.groupBy("_id", "_th").agg(F.collect_set(F.struct((F.col("start") + F.col("m.a")).alias("start"), (F.col("start") + F.col("m.b")).alias("end"))).alias("spans"))
    return cut(spans, "spans")


def covered(length: int, spans: list[dict] | None) -> np.ndarray:
    """Which of ``length`` symbols lie in a span."""
    edge = np.zeros(length + 1, np.int64)
    if spans:
        np.add.at(edge, np.minimum([s["start"] for s in spans], length), 1)
        np.add.at(edge, np.minimum([s["end"] for s in spans], length), -1)
    return np.cumsum(edge[:-1]) > 0


def stripped(docs: DataFrame, spans: DataFrame, strip: Batches, columns: str, text: str = "text") -> DataFrame:
    """Every row of ``docs``, with its columns as the struct ``row`` (but for the text) and what ``strip`` makes of (row, _text, spans): ``columns``.

    Only rows that a filter of the spans' documents lets pass are shuffled.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), *keys(text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    some, others = Bloom(spans).split(rows)
    kind = T.StructType([rows.schema["row"], *T._parse_datatype_string(columns).fields])
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    changed = squeezed(some).join(spans, ["_id", "_th"], "left").select("row", "_z", "spans").mapInArrow(lambda batches: strip(opened(batches)), kind)
    return others.select("row", "_text", none).mapInArrow(strip, kind).unionAll(changed)
