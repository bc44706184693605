"""Suffix-array dedup of bytes by prefix-free parsing.

``repeats`` parses the corpus into phrases at rolling-hash triggers and counts the distinct phrases, the dictionary.
A phrase with several places repeats as a whole. Each trigger's phrases, a short and highly repetitive collection, are
parsed once more: a rolling hash over ``WINDOW`` bytes triggers a phrase end, phrases overlap by the trigger, and the
distinct ones make a dictionary. The suffix array of the dictionary and the suffix array of the parse (the phrases as
symbols) combine into the order of all suffixes: first by the rest of the suffix's own phrase, then by what follows in
the parse. No phrase suffix longer than a trigger is a prefix of another, so that order is the lexicographic one, and
strings of ``span`` bytes repeat where neighbours in it have a common prefix of that length, compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm import repeats
from rillflow.llm.text_arrays import Rolling, U, byte_symbols, chunks

WINDOW, MODULUS = 8, 24
BYTES = repeats.Repeats("bytes", span=200, grams=(32, 80, 140, 200), first=False)


def ranks(symbols: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Rank (from 1) of each suffix among all, compared over ``left`` symbols each, ``most`` at most; equal suffixes
    share one. ``symbols`` are below 2**9 and positive. Prefix doubling over the suffixes that still tie."""
    n, step = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(step, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << 9) | np.where(left > k, padded[k : k + n], 0)
    return double(key, left, step, most)


def double(key: np.ndarray, left: np.ndarray, step: int, most: int) -> np.ndarray:
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)
    head = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1 if n else 0) != 0)
    sizes = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, sizes) + 1
    tied = order[np.repeat(sizes > 1, sizes)]
    while len(tied) and step < most:
        live = left[tied] > step
        after = np.where(live, rank[np.minimum(tied + step, n - 1)], 0)
        again = np.lexsort((after, rank[tied]))
        tied, after = tied[again], after[again]
        old = rank[tied]
        new_group = np.diff(old, prepend=-1) != 0
        new = new_group | (np.diff(after, prepend=-1) != 0)
        place = np.arange(len(tied))
        first_of_group = np.maximum.accumulate(np.where(new_group, place, 0))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = old + first - first_of_group
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        keep = np.repeat(sizes > 1, sizes)
        tied = tied[keep]
        step *= 2
    return rank


def corpus_order(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys that order the suffixes of all texts, laid end to end from ``at``: dictionary rank, parse rank."""
    begin, size, n = at[:-1], np.diff(at), len(body)
    text_of = np.repeat(np.arange(len(size)), size)
    text_end = (begin + size)[text_of]
    rolling = Rolling(byte_symbols(body))
    trigger = np.zeros(n, bool)
    grams = rolling.grams(WINDOW)
    hit = np.flatnonzero(grams % U(MODULUS) == 0)
    trigger[hit[hit + WINDOW <= text_end[hit]]] = True
    trigger[begin[size > 0]] = True
    start = np.flatnonzero(trigger)  # of each phrase
    following = np.append(start[1:], n)
    end = np.where(following < text_end[start], following + WINDOW, text_end[start])
    # The dictionary: distinct phrases; one that ends its text is another phrase than one that ends in a trigger.
    name = rolling.of(start, end) ^ (end - start).astype(np.uint64) ^ np.where(following < text_end[start], U(0), U(1) << U(63))
    _, first, phrase = np.unique(name, return_index=True, return_inverse=True)
    length = (end - start)[first]
    word_begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(word_begin, length)
    dictionary = body[np.repeat(start[first], length) + place].astype(np.int64) + 2
    left = np.repeat(length, length) - place
    closed = np.repeat(following[first] >= text_end[start[first]], length)
    # A closed phrase has an end symbol of its own (1): it sorts before whatever goes on.
    marks = np.concatenate([dictionary, np.ones(1, np.int64)])
    suffix_rank = ranks(marks[:-1], left, int(length.max()) if len(length) else 0)
    suffix_rank = 2 * suffix_rank + ~closed
    # The parse, with phrases named by rank; it goes on to the end of its own text.
    parse = suffix_rank[word_begin][phrase]
    parse_text = text_of[start]
    parse_left = np.searchsorted(parse_text, parse_text, side="right") - np.arange(len(parse))
    parse_rank = double(parse, parse_left, 1, int(parse_left.max()) if len(parse) else 0)
    mine = np.cumsum(trigger) - 1  # the phrase of each place
    rest = suffix_rank[word_begin[phrase[mine]] + np.arange(n) - start[mine]]
    goes_on = parse_left[mine] > 1
    follow = np.where(goes_on, parse_rank[np.minimum(mine + 1, len(parse) - 1)], 0)
    return rest, follow


def common(body: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Whether the bytes from ``p`` and from ``q`` agree over ``length``: eight at a time, while they do."""
    if length < 8:
        return np.all([body[p + k] == body[q + k] for k in range(length)], axis=0)
    packed = np.zeros(len(body) - 7, np.uint64)
    for k in range(8):
        packed |= body[k : len(body) - 7 + k].astype(np.uint64) << U(8 * k)
    live = np.arange(len(p))
    for k in [*range(0, length - 8, 8), length - 8]:
        live = live[packed[p[live] + k] == packed[q[live] + k]]
    out = np.zeros(len(p), bool)
    out[live] = True
    return out


def solve(body: np.ndarray, at: np.ndarray, bag: dict[str, np.ndarray], how: repeats.Repeats) -> np.ndarray:
    """Which windows of the phrases, each of one place, also start elsewhere in these phrases: neighbours in corpus order with ``span`` common bytes."""
    rest, follow = corpus_order(body, at)
    many = np.maximum(np.diff(at) - how.span + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    here = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    order = np.lexsort((follow[here], rest[here]))
    flags = np.zeros(len(here), bool)
    if len(here) > 1:
        same = common(body, here[order[1:]], here[order[:-1]], how.span)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
    return flags & (bag["places"][owner] < 2)


def _strip(keep_text: bool) -> repeats.Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in chunks(batches, "_text"):
            raw = body.tobytes()
            removed, count, digest, kept = [], [], [], []
            for i, s in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                if not s:
                    rest = raw[a:b]
                    removed.append(0), count.append(0)
                else:
                    gone = repeats.covered(b - a, s)
                    rest = body[a:b][~gone].tobytes()
                    removed.append(int(gone.sum())), count.append(len(repeats.runs(gone)[0]))
                digest.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    kept.append(rest.decode("utf-8", "replace"))
            columns = {"n_bytes": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if keep_text:
                columns["kept"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], names=["row", *columns])

    return run


def remove_repeated_bytes(docs: DataFrame, how: repeats.Repeats = BYTES, text: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, kept) of every row of ``docs(doc_id, text)``.

    Removed is each byte covered by a string of ``how.span`` bytes that also starts anywhere else, in the same or
    another row; strings are judged on the input. Matches never cross rows. Null text is empty; of repeated rows
    each is elsewhere for the others; ids may be null or shared; texts below ``span`` bytes stay; bytes that no longer
    are UTF-8 show as U+FFFD in ``kept``. An empty table gives none; other columns are ignored.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text")
    columns = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * keep_text
    return repeats.stripped(rows, repeats.repeated_spans(rows, how, solve), _strip(keep_text), columns).select("row.doc_id", *[c.split()[0] for c in columns.split(", ")])
