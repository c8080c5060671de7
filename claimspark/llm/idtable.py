"""A bounded table of pieces of text and their ids, looked up for whole Arrow arrays at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one list after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


class IdTable:
    def __init__(self, most: int) -> None:
        """most: pieces held; when more come the table starts anew."""
        self._most = most
        self._forget()

    def _forget(self) -> None:
        #: The pieces, all their ids, where the ids of each begin, and how many there are.
        self._words, self._ids = pa.array([], pa.string()), np.zeros(0, "<u4")
        self._starts = self._sizes = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self._words)

    def find(self, words: pa.Array, usable: np.ndarray, make: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """The places of words, each given once. Usable ones that are not there are made (their ids as little-endian
        unsigned 32-bit integers) and added; the others have place -1."""
        at = pc.fill_null(pc.index_in(words, value_set=self._words), -1).to_numpy().astype(np.int64)
        new = (at < 0) & usable
        if new.any():
            if len(self) + int(new.sum()) > self._most:
                self._forget()
                at, new = np.full(len(words), -1), usable
            learnt = words.filter(pa.array(new))
            at[new] = len(self) + np.arange(len(learnt))
            made = make(learnt.to_pylist())
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
            self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
            self._sizes = np.concatenate([self._sizes, sizes])
            self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(made), "<u4")])
            self._words = pa.concat_arrays([self._words, learnt])
        return at

    def ids(self, at: np.ndarray, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of places, one after the other, and how many each has; own: ids of the places behind the table's."""
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
        counts = np.concatenate([self._sizes, sizes])[at]
        return np.concatenate([self._ids, np.frombuffer(b"".join(own), "<u4")])[places(starts[at], counts)], counts
