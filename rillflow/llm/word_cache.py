"""Token ids of words, kept from chunk to chunk in a Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from rillflow.llm.text_arrays import grouped

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class WordCache:
    """Encodes each distinct word once. Over ``most`` words it starts afresh, so its memory is bounded."""

    def __init__(self, encode: Encode, most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _fit(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def ids(self, hashes: np.ndarray, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has."""
        codes, distinct = pd.factorize(hashes)
        if len(self.slot) + len(distinct) > self.most:
            self.clear()
        slots = np.fromiter((self.slot.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = body.tobytes()
            flat, lengths = self.encode([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at, n = self.used, len(self.slot)
            self.flat = self._fit(self.flat, at + len(flat))
            self.flat[at : at + len(flat)] = flat
            self.start, self.length = self._fit(self.start, n + len(new)), self._fit(self.length, n + len(new))
            self.start[n : n + len(new)] = at + np.cumsum(lengths) - lengths
            self.length[n : n + len(new)] = lengths
            self.used = at + len(flat)
            slots[new] = np.arange(n, n + len(new))
            self.slot.update(zip(distinct[new].tolist(), slots[new].tolist(), strict=True))
        each = slots[codes]
        counts = self.length[each]
        word, place = grouped(counts)
        return self.flat[self.start[each][word] + place], counts
