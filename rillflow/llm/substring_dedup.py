"""Substring dedup of words by suffix trees over groups of suffixes.

The suffixes that matter are the windows of ``repeats``, dealt to groups by the words at their trigger: five, and in a
group too large for memory ten, fifteen, then all twenty. Of each group a suffix tree is built, down to depth ``span``:
its leaves in order, with the common prefix of neighbours. Internal nodes of that depth are maximal runs of leaves
whose neighbours share ``span`` words; their path is a repeat, of which the earliest leaf stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm import repeats
from rillflow.llm.suffix_dedup import double
from rillflow.llm.text_arrays import chunks, word_symbols, words

WORDS = repeats.Repeats("words", span=20, grams=(5, 10, 15, 20), first=True)


def suffix_tree(symbols: np.ndarray, left: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the suffixes that begin at ``suffixes``, cut at ``depth``: its leaves (places in ``suffixes``) in order, and
    the depth of the node at which each leaf parts from the one before it. ``left``: symbols up to the end of a suffix's text."""
    _, names = np.unique(symbols, return_inverse=True)
    rank = double(names.astype(np.int64) + 1, left, 1, depth)
    order = np.argsort(rank[suffixes], kind="stable")
    p, q = suffixes[order[:-1]], suffixes[order[1:]]
    common, live = np.zeros(len(order), np.int64), np.arange(len(p))
    for k in range(depth):
        live = live[(np.minimum(left[p[live]], left[q[live]]) > k)]
        live = live[names[p[live] + k] == names[q[live] + k]]
        common[live + 1] += 1
    return order, common


def deep_nodes(order: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, node) of the leaves below internal nodes of ``depth``, nodes in ascending order."""
    node = np.cumsum(common < depth) - 1
    inner = np.bincount(node, minlength=1)[node] > 1 if len(node) else np.zeros(0, bool)
    return order[inner], node[inner]


def solve(body: np.ndarray, at: np.ndarray, bag: dict[str, np.ndarray], how: repeats.Repeats) -> np.ndarray:
    """Which windows of each phrase start earlier in these phrases, by (id, start)."""
    begin, end, first = words(body, at)
    count = np.diff(first)
    many = np.maximum(count - how.span + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    left = np.repeat(first[1:], count) - np.arange(len(begin))
    leaf, node = deep_nodes(*suffix_tree(word_symbols(body, begin, end), left, first[owner] + place, how.span), how.span)
    flags = np.zeros(len(owner), bool)
    if len(leaf):
        ids, starts = bag["id"][owner[leaf]], bag["start"][owner[leaf]] + place[leaf]
        by = np.lexsort((starts, ids, node))
        head = np.append(True, node[by][1:] != node[by][:-1])
        least = by[head][np.cumsum(head) - 1]
        flags[leaf[by]] = (ids[by] != ids[least]) | (starts[by] != starts[least])
    return flags


def _strip(keep_text: bool) -> repeats.Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in chunks(batches, "_text"):
            begin, end, first = words(body, at)
            raw = body.tobytes()
            removed, digest, kept = [], [], []
            for i, s in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                lo, hi = int(first[i]), int(first[i + 1])
                gone = repeats.covered(hi - lo, s)
                stay = lo + np.flatnonzero(~gone)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)])).hexdigest())
                if keep_text:
                    # What goes is each run of words with the white space after it.
                    edges = begin[lo:hi].tolist() + [int(at[i + 1])]
                    text, here = [], int(at[i])
                    for a, b in zip(*(x.tolist() for x in repeats.runs(gone)), strict=True):
                        text.append(raw[here : edges[a]])
                        here = edges[b]
                    text.append(raw[here : int(at[i + 1])])
                    kept.append(b"".join(text).decode("utf-8", "replace"))
            columns = {"n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if keep_text:
                columns["kept"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], names=["row", *columns])

    return run


def remove_repeated_words(docs: DataFrame, how: repeats.Repeats = WORDS, text: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, the other columns as the struct row, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept) of every row of ``docs(doc_id, text)``.

    Removed is each word covered by a window of ``how.span`` words whose sequence also starts earlier: in a document
    of smaller doc_id, or before it in the same one. Windows are judged on the input. Null text has no words; a null
    doc_id comes before all others; rows that share a doc_id are one document, so of repeated rows each stays what the
    others are; documents of fewer words stay. An empty table gives none.
    """
    columns = "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text
    out = repeats.stripped(docs, repeats.repeated_spans(docs, how, solve, text), _strip(keep_text), columns, text)
    return out.select("row.doc_id", "row", *[c.split()[0] for c in columns.split(", ")])
