"""Texts as flat byte and word arrays: whole Arrow batches at a time, without a Python object for each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. A longer text is handled alone and whole.
CHUNK_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed)) * U(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get("base")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1, 2 * (0 if have is None else len(have)))
        base = int(seeded(1, 77)[0]) | 1
        for name, value in (("base", base), ("inverse", pow(base, -1, 1 << 64))):
            powers = np.full(size, value, dtype=np.uint64)
            powers[0] = 1
            _POWERS[name] = np.cumprod(powers, dtype=np.uint64)
    return _POWERS["base"], _POWERS["inverse"]


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit symbols, by prefix sums of a polynomial."""

    def __init__(self, symbols: np.ndarray):
        base, self.inverse = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * base[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of ``k`` symbols."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each row starts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each, their bytes and the rows' offsets."""
    for batch in batches:
        body, at = bytes_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), body[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = seeded(256, 1)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]


def byte_symbols(body: np.ndarray, lower: bool = False) -> np.ndarray:
    return (_BYTES_LOWER if lower else _BYTES)[body]


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and where each row's words start."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~_BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at[at <= len(body)]] = True
    before = np.concatenate([[False], ink[:-1]]) & ~edge[:-1]
    after = np.concatenate([ink[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_symbols(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word."""
    return Rolling(byte_symbols(body, lower)).of(starts, ends) + U(1)


def grouped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each item's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
