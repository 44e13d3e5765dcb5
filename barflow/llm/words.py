"""Words of Arrow texts as indices into a growing table: each distinct word of a batch reaches Python once."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut(texts: pa.Array, separator: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Index of each part among the distinct parts, the number of parts of each text, and the distinct parts."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), separator)
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), count, coded.dictionary.to_pylist()


class Table:
    """Ids of known words as one flat array; a word's index is its place in order of arrival."""

    def __init__(self, dtype: type) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64)

    def add(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        n = len(self.index)
        start = int(self.ends[n - 1]) if n else 0
        while start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[start : start + len(ids)] = ids
        self.ends[n : n + len(words)] = start + np.cumsum(count)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def keep_half(self) -> None:
        """Drop the later half: the words met first are the frequent ones."""
        n = len(self.index) // 2
        self.index = dict(islice(self.index.items(), n))

    def missing(self, words: list[str]) -> list[str]:
        return [w for w in words if w not in self.index]

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of the words at these places."""
        if not len(self.index):
            return at, at
        starts = np.where(at > 0, self.ends[at - 1], 0)
        return starts, self.ends[at] - starts


def gather(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after another."""
    done = np.cumsum(size)
    return flat[np.repeat(starts - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]
