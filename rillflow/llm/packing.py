"""Order-preserving packing of token streams into fixed windows, by dynamic programming.

Each partition packs its documents in the order in which it holds them; documents are never reordered or shuffled.
Over the stream of a partition, cuts may fall at a document's end (free), at a sentence's end, or, in stretches that
have neither, on a grid. The cost of a window is its padding and the penalty of the cut that ends it:
``best[j] = penalty[j] + window - pos[j] + min(best[i] + pos[i])`` over ``pos[j] - window <= pos[i] < pos[j]``, and the
minimum is the head of a monotone queue, so every cut is chosen with constant amortised work.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillflow.llm.text_arrays import CHUNK_BYTES, chunks, word_symbols, words
from rillflow.llm.word_cache import WordCache

WINDOW = 2048
#: Tokens of padding that a cut at a sentence's end, or in the middle of a sentence, is worth avoiding.
SENTENCE_PENALTY, HARD_PENALTY, GRID = 2, 12, 32
#: Tokens gathered before a run of the dynamic programme; what its last window holds is carried to the next run.
RUN_TOKENS = 1 << 20


def cut_points(length: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, grid: int = GRID, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream of ``length`` tokens may be cut, ascending, with penalties. ``grid`` is at most ``window``."""
    grid = min(grid, window)
    own = np.sort(np.concatenate([doc_ends, sentence_ends, [length]]).astype(np.int64), kind="stable")
    own = own[np.diff(own, prepend=0) > 0]
    gaps = np.diff(np.concatenate([[0], own]))
    wide = np.flatnonzero(gaps > grid)
    extra = [np.arange(own[i] - gaps[i] + grid, own[i], grid) for i in wide]
    points = np.sort(np.concatenate([own, *extra]), kind="stable")
    cost = np.full(length + 1, HARD_PENALTY, np.int64)
    cost[sentence_ends] = SENTENCE_PENALTY
    cost[doc_ends] = 0
    penalty = cost[points]
    penalty[-1] = 0
    return points, penalty


def best_cuts(points: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts of least padding and penalties; gaps between points are at most ``window``."""
    pos, costs = [0, *points.tolist()], [window, *(penalty + window).tolist()]
    back = [0] * len(pos)
    # The monotone queue: points in order, with ascending best[i] + pos[i]; ``head`` is the oldest within the window.
    queue, keys, head = [0], [0], 0
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[queue[head]] < here - window:
            head += 1
        back[j] = queue[head]
        key = costs[j] + keys[head]  # best[j] + pos[j]
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def tail_cuts(start: int, end: int, window: int = WINDOW) -> list[int]:
    """Cuts of a last, short window into powers of two, which take no padding."""
    out, size = [], window
    while start < end:
        while size > end - start:
            size //= 2
        start += size
        out.append(start)
    return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Packs one partition's documents, ``RUN_TOKENS`` at a time."""

    def __init__(self, sentence_ids: np.ndarray, window: int = WINDOW, run_tokens: int = RUN_TOKENS, first_sequence: int = 0):
        self.window, self.run_tokens, self.sequence = window, run_tokens, first_sequence
        self.ends_sentence = np.zeros(1 << 17, bool)
        self.ends_sentence[sentence_ids] = True
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # id, ids of the document before these, all its ids, these
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)
        if self.size >= self.run_tokens:
            yield from self.run(last=False)

    def run(self, last: bool = True) -> Iterator[dict]:
        if not self.docs:
            return
        stream = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        cuts = best_cuts(*cut_points(len(stream), ends, np.flatnonzero(self.ends_sentence[stream]) + 1, window=self.window), self.window)
        if last:
            short = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
            if short < self.window:
                cuts = cuts[:-1] + tail_cuts(cuts[-1] - short, cuts[-1], self.window)
        else:
            cuts = cuts[:-1]
        k, at = 0, 0  # document, ids of it already placed
        begin = 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc_id, before, total, ids = self.docs[k]
                n = min(len(ids) - at, cut - begin)
                if n:
                    piece = np.ascontiguousarray(ids[at : at + n], "<u4")
                    yield dict(zip(_FIELDS, (doc_id, before + at, n, zlib.crc32(piece.tobytes()), total, self.sequence, offset), strict=True))
                offset, begin, at = offset + n, begin + n, at + n
                if at == len(ids):
                    k, at = k + 1, 0
            self.sequence += 1
        left = self.docs[k:]
        if left and at:
            doc_id, before, total, ids = left[0]
            left[0] = (doc_id, before + at, total, ids[at:])
        self.docs, self.size = left, int(len(stream) - begin)


_CACHES: dict[str, tuple[WordCache, np.ndarray]] = {}
_WHOLE: dict[str, tuple] = {}


def whole_texts(path: str) -> tuple:
    """The unmodified library tokenizer, and a pattern of the texts that hold one of its added tokens: those are encoded as a whole."""
    if path not in _WHOLE:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content.encode()) for t in tokenizer.get_added_tokens_decoder().values()]
        _WHOLE[path] = tokenizer, re.compile(b"|".join(added), re.IGNORECASE) if added else None
    return _WHOLE[path]


def release() -> None:
    """Forget the tokenizers and the words they have seen: a worker that waits for other work holds none of it."""
    _CACHES.clear()
    _WHOLE.clear()


def word_tokenizer(path: str) -> tuple[WordCache, np.ndarray]:
    """A worker's tokenizer for texts whose tokens never cross ASCII white space, and the ids that end a sentence."""
    if path not in _CACHES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab()
        ends = [i for t, i in vocabulary.items() if (s := t.removesuffix("</w>")) and t.endswith("</w>") and s[-1] in ".!?" and not any(c.isalnum() for c in s)]

        closes = np.zeros(max(vocabulary.values()) + 1, bool)
        closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

        def one_part(word: str) -> bool:
            """Whether the pre-tokenizer surely leaves ``word`` whole: it then has one token that closes a word, its last."""
            return (word.isascii() and "'" not in word) or normalize("NFC", word).lower().isalpha()

        def encode(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # Many to a call, a space between them. Closing tokens tell the words apart, or else where each token starts.
            flat, lengths = [], []
            for i in range(0, len(found), 256):
                some = [w.decode("utf-8", "replace") for w in found[i : i + 256]]
                e = tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids = np.array(e.ids, np.int64)
                last = np.flatnonzero(closes[ids])
                if len(last) == len(some) and all(map(one_part, some)):
                    lengths.append(np.diff(last, prepend=-1))
                else:
                    begin = np.cumsum([0] + [len(w) + 1 for w in some])
                    lengths.append(np.histogram([a for a, _ in e.offsets], begin)[0])
                flat.append(ids)
            return (np.concatenate(flat), np.concatenate(lengths)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        _CACHES[path] = WordCache(encode, 400_000), np.array(sorted(ends), np.uint32)
    return _CACHES[path]


_KIND = np.zeros(256, np.int8)  # 0: joins with either neighbour
_KIND[33:127] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
_KIND[39] = 0


def units(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut further where their kind of ASCII character changes and at digits: the tokenizer cuts there as well
    (apostrophes may belong to either side and never are a cut). Fewer distinct units than words."""
    starts, ends, first = words(body, at)
    if not len(starts):
        return starts, ends, first
    kind = _KIND[body]
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    cut &= (kind[1:] > 0) & (kind[:-1] > 0)
    more = np.flatnonzero(cut) + 1
    starts, ends = np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
    keep = np.append(starts[1:] != starts[:-1], True)
    starts, ends = starts[keep], ends[np.insert(ends[1:] != ends[:-1], 0, True)]
    return starts, ends, np.searchsorted(starts, at)


def tokens(batches: Iterator[pa.RecordBatch], path: str, text: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of each row, ``end_id`` last."""
    cache, _ = word_tokenizer(path)
    tokenizer, added = whole_texts(path)
    for batch, body, at in chunks(batches, text):
        starts, ends, first = units(body, at)
        flat, counts = cache.ids(word_symbols(body, starts, ends, lower=True), body, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        upto = np.concatenate([[0], np.cumsum(counts)])[first]
        ids = [np.append(flat[a:b], np.uint32(end_id)) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        raw = body.tobytes()
        for i in sorted({int(np.searchsorted(at, m.start(), side="right")) - 1 for m in added.finditer(raw)}) if added else ():
            given = tokenizer.encode(raw[at[i] : at[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids
            ids[i] = np.array([*given, end_id], np.uint32)
        yield batch, ids


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, run_tokens: int = RUN_TOKENS, text: str = "text") -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``; null text is empty and has ``end_id`` alone. Every row is packed,
    repeated ones and null ids too; an empty table gives none. ``sequence_id`` holds the partition's number in its
    upper bits, so it is unique without a shuffle and the same when a lost task runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sentence_ids = word_tokenizer(tokenizer_path)
        packer = Packer(sentence_ids, window, run_tokens, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        rows: list[dict] = []
        for batch, each in tokens(batches, tokenizer_path, "_text", end_id):
            for doc_id, ids in zip(batch.column(0).to_pylist(), each, strict=True):
                rows.extend(packer.add(doc_id, ids))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        rows.extend(packer.run())
        release()
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as _text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([(n, pa.int64()) for n in _FIELDS])
