"""Unigram encoding and decoding of SentencePiece vocabularies.

Pieces lie in a double-array trie over UTF-8 bytes. All matches of all positions of a chunk are found together, one
trie step at a time; a Viterbi pass then keeps, for every end, the start of the best sum of log scores. A character
that is no piece costs ``UNKNOWN_DROP`` below the worst score and falls back to its byte pieces.

White space: ``U+2581`` stands for a space, one is put before a text that isn't empty, and decoding takes it away. No
piece has a marker after another character, so the best segmentation never crosses the start of a run of markers and
the runs' texts are encoded once each (``WordCache``). Inside, the marker is the single byte 0x20.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rillflow.llm.text_arrays import Rolling, U, byte_symbols, chunks, grouped
from rillflow.llm.word_cache import WordCache

MARK, UNKNOWN_DROP = "▁", 10.0
#: Texts of up to so many bytes take the Viterbi pass together; longer ones take it one by one.
TOGETHER = 64
#: Words whose ids a worker keeps.
MOST_WORDS = 300_000


class DoubleArray:
    """A trie in two arrays: the child of ``s`` by byte ``c`` is ``t = base[s] + c + 1`` if ``check[t] == s``."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = family = 257
        work = [(0, 0, len(order), 0)]
        for state, lo, hi, depth in work:
            kids: list[tuple[int, int, int]] = []
            i = lo
            while i < hi and len(keys[order[i]]) == depth:
                value[state] = order[i]
                i += 1
            while i < hi:
                c, j = keys[order[i]][depth], i
                while j < hi and keys[order[j]][depth] == c:
                    j += 1
                kids.append((c, i, j))
                i = j
            if not kids:
                continue
            # A lone child takes the first free place; families search on from where searching got long.
            while free < size and check[free] >= 0:
                free += 1
            tries, at = 0, max(0, (free if len(kids) == 1 else max(free, family)) - kids[0][0] - 1)
            while True:
                if at + 257 >= size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if all(check[at + c + 1] < 0 for c, _, _ in kids):
                    break
                at += 1
                tries += 1
            if len(kids) > 1 and tries > 64:
                family = at + kids[0][0] + 1
            base[state] = at
            for c, a, b in kids:
                check[at + c + 1] = state
                work.append((at + c + 1, a, b, depth + 1))
        pad = [-1] * 257
        self.base, self.check, self.value = (np.array(x + p, np.int32) for x, p in ((base, [0] * 257), (check, pad), (value, pad)))

    def matches(self, body: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of every key found from any of ``at``, not past its ``stop``."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start, state, here = at, np.zeros(len(at), np.int32), at.copy()
        while True:
            live = here < stop
            start, state, here, stop = start[live], state[live], here[live], stop[live]
            if not len(start):
                break
            child = self.base[state] + body[here] + 1
            live = self.check[child] == state
            start, state, here, stop = start[live], child[live], here[live] + 1, stop[live]
            hit = self.value[state] >= 0
            found.append((start[hit], here[hit], self.value[state[hit]]))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))  # type: ignore[return-value]


@dataclass
class Vocabulary:
    """Pieces by id, their log scores, ids of the byte pieces, and which ids are ordinary pieces."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    ordinary: np.ndarray
    unknown_id: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
        byte = np.array([model.is_byte(i) for i in range(n)])
        special = byte | np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        byte_ids = np.full(256, -1)
        for i in np.flatnonzero(byte):
            byte_ids[int(pieces[i][3:5], 16)] = i
        return Vocabulary(pieces, scores, byte_ids, ~special, model.unk_id())


class Unigram:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.ids = np.array([i for i in np.flatnonzero(v.ordinary) if v.pieces[i]])
        keys = [v.pieces[i].replace(MARK, " ").encode() for i in self.ids]
        if any(b" " in k.lstrip(b" ") for k in keys):
            raise ValueError("a piece has a white-space marker after another character")
        self.trie = DoubleArray(keys)
        self.key_scores = v.scores[self.ids]
        self.unknown_score = float(self.key_scores.min()) - UNKNOWN_DROP if len(self.ids) else -UNKNOWN_DROP
        self.fallback = bool((v.byte_ids >= 0).all())
        raw = [b""] * len(v.pieces)
        for i, k in zip(self.ids, keys, strict=True):
            raw[i] = k
        for b, i in enumerate(v.byte_ids):
            if i >= 0:
                raw[i] = bytes([b])
        self.piece_length = np.array([len(r) for r in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.cache = WordCache(self.encode_words, MOST_WORDS)

    def encode_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these texts end to end, and how many each has."""
        body = np.frombuffer(b"".join(found), np.uint8)
        lengths = np.array([len(w) for w in found], np.int64)
        begin = np.cumsum(lengths) - lengths
        word, _ = grouped(lengths)
        first = (body & 0xC0) != 0x80
        first[begin[lengths > 0]] = True
        at = np.flatnonzero(first)
        start, end, key = self.trie.matches(body, at, (begin + lengths)[word[at]])
        score, ids = self.key_scores[key], self.ids[key]
        after = np.append(at[1:], len(body))  # the end of each character
        known = np.zeros(len(body) + 1, bool)
        known[start[end == after[np.searchsorted(at, start)]]] = True
        odd = ~known[at]
        start, end = np.concatenate([start, at[odd]]), np.concatenate([end, after[odd]])
        score = np.concatenate([score, np.full(odd.sum(), self.unknown_score)])
        ids = np.concatenate([ids, np.full(odd.sum(), -1)])
        best, back, by = np.full(len(body) + 1, -np.inf), np.zeros(len(body) + 1, np.int64), np.full(len(body) + 1, -1)
        # A text's own start and the end of the one before share a place: starts are read from ``begin`` as zero.
        of = word[start]
        short = lengths[of] <= TOGETHER
        self._together(start[short], end[short], score[short], ids[short], begin[of[short]], best, back, by)
        rest = np.flatnonzero(~short)
        rest = rest[np.lexsort((start[rest], end[rest]))]
        for s, e, x, i, b in zip(start[rest].tolist(), end[rest].tolist(), score[rest].tolist(), ids[rest].tolist(), begin[of[rest]].tolist(), strict=True):
            total = (0.0 if s == b else best[s]) + x
            if total > best[e]:
                best[e], back[e], by[e] = total, s, i
        return self._back(body, begin, lengths, back, by)

    @staticmethod
    def _together(start: np.ndarray, end: np.ndarray, score: np.ndarray, ids: np.ndarray, begin: np.ndarray, best: np.ndarray, back: np.ndarray, by: np.ndarray) -> None:
        if not len(start):
            return
        order = np.lexsort((start, end, end - begin))
        start, end, score, ids, begin = start[order], end[order], score[order], ids[order], begin[order]
        depth = end - begin
        firsts = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(depth)).tolist(), strict=True):
            total = np.where(start[a:b] == begin[a:b], 0.0, best[start[a:b]]) + score[a:b]
            heads = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            top = np.maximum.reduceat(total, heads)
            sizes = np.diff(np.append(heads, b - a))
            win = np.flatnonzero(total == np.repeat(top, sizes))
            win = win[np.diff(end[a:b][win], prepend=-1) != 0]  # of equal sums the earliest start
            e = end[a:b][win]
            best[e], back[e], by[e] = total[win], start[a:b][win], ids[a:b][win]

    def _back(self, body: np.ndarray, begin: np.ndarray, lengths: np.ndarray, back: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, here = np.flatnonzero(lengths > 0), (begin + lengths)[lengths > 0]
        owners, starts, ends, found = [], [], [], []
        while len(owner):
            owners.append(owner), ends.append(here), found.append(by[here])
            here = back[here]
            starts.append(here)
            go = here > begin[owner]
            owner, here = owner[go], here[go]
        if not owners:
            return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        owner, start, end, ids = (np.concatenate(x) for x in (owners, starts, ends, found))
        order = np.lexsort((start, owner))
        owner, start, end, ids = owner[order], start[order], end[order], ids[order]
        many = np.where((ids < 0) & self.fallback, end - start, 1)
        which, place = grouped(many)
        out = ids[which]
        odd = out < 0
        out[odd] = self.vocabulary.byte_ids[body[start[which[odd]] + place[odd]]] if self.fallback else self.vocabulary.unknown_id
        return out.astype(np.uint32), np.bincount(owner, many, len(lengths)).astype(np.int64)

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row's ids start. ``body``: marked texts (``marked``)."""
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        space = body == 0x20
        edge = space & ~np.concatenate([[False], space[:-1]])
        edge[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(body))
        flat, counts = self.cache.ids(Rolling(byte_symbols(body)).of(starts, ends) + U(1), body, starts, ends)
        return flat, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, at)]

    def decode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end with their leading marker, and where each row starts."""
        counts = self.piece_length[flat]
        piece, place = grouped(counts)
        return self.piece_bytes[self.piece_start[flat][piece] + place], np.concatenate([[0], np.cumsum(counts)])[at]


def marked(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """``batch`` with a marker before each text that isn't empty, and markers in texts as spaces."""
    i = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(i).cast(pa.large_string()), "")
    text = pc.replace_substring(text, MARK, " ")
    none, lead = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    text = pc.if_else(pc.equal(text, none), none, pc.binary_join_element_wise(lead, text, none))
    return batch.set_column(i, column, text)


_LOADED: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    """A Python worker's encoder for a model file."""
    if path not in _LOADED:
        _LOADED[path] = Unigram(Vocabulary.load(path))
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of ``docs``. Null and empty texts have no ids; repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_path)
        for batch, body, at in chunks((marked(b, "_text") for b in batches), "_text"):
            flat, upto = model.encode(body, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as _text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Byte pieces join into UTF-8 (what isn't UTF-8 becomes U+FFFD); null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                flat = np.array(ids or [], np.int64)
                body, _ = model.decode(flat, np.array([0, len(flat)]))
                raw = body.tobytes()
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Encode and decode every row: doc_id, n_tokens, n_fallback (byte pieces), ids_crc32 (little-endian 32-bit ids),
    decoded_sha256 (lowercase hex of the decoded bytes) and exact (whether they are the text, markers as spaces).

    Null text is empty and has no pieces; of equal scores the longest last piece wins; a text of any length is encoded
    whole; repeated rows and null ids give a row each; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_path)
        byte = np.zeros(len(model.vocabulary.pieces), bool)
        byte[model.vocabulary.byte_ids[model.vocabulary.byte_ids >= 0]] = True
        for batch, body, at in chunks((marked(b, "_text") for b in batches), "_text"):
            flat, upto = model.encode(body, at)
            back, places = model.decode(flat, upto)
            odd = np.concatenate([[0], np.cumsum(byte[flat])])[upto]
            raw, ids, given = back.tobytes(), flat.astype("<u4").tobytes(), body.tobytes()
            spans = list(zip(places[:-1].tolist(), places[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(upto), pa.int64()), pa.array(np.diff(odd), pa.int64()),
                    pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(raw[a + 1 : b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([raw[a:b] == given[c:d] for (a, b), c, d in zip(spans, at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "n_fallback", "ids_crc32", "decoded_sha256", "exact"],
            )

    schema = "doc_id bigint, n_tokens bigint, n_fallback bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as _text").mapInArrow(run, schema)
