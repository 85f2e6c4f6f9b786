"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

PRIME = np.uint64(1099511628211)
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def ngrams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of <word>, boundary marks included, and of the whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    owners, found = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * PRIME + codes[n - 1 :]
        if n in sizes:
            whole = word[: len(codes) - n + 1] == word[n - 1 :]
            owners.append(word[: len(codes) - n + 1][whole])
            found.append(h[whole] + np.uint64(n))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    owners.append(np.arange(len(words)))
    found.append(np.add.reduceat((codes + np.uint64(1)) * (MIX ** (place.astype(np.uint64) % np.uint64(61) + np.uint64(1))), starts))
    return np.concatenate(owners), ((np.concatenate(found) * MIX) >> np.uint64(40)).astype(np.int64) % buckets


class WordTable:
    """Values of words, worked out once per distinct word and task. value(words) gives an array with a row per word."""

    def __init__(self, value: Callable[[list[bytes]], np.ndarray], most: int = 250_000):
        self.value, self.most = value, most
        self.clear()

    def clear(self) -> None:
        self.ids, self.rows = WordIds(), None

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The rows of these words."""
        if len(self.ids) > self.most:
            self.clear()
        known = len(self.ids)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > known:
            fresh = list(self.ids)[known:] if not known else [w for w, _ in zip(reversed(self.ids), range(len(self.ids) - known))][::-1]
            new = self.value(fresh)
            if self.rows is None:
                self.rows = new
            else:
                if known + len(new) > len(self.rows):
                    room = np.zeros((max(2 * len(self.rows), known + len(new)), *new.shape[1:]), new.dtype)
                    room[:known] = self.rows[:known]
                    self.rows = room
                self.rows[known : known + len(new)] = new
        if self.rows is None:
            return self.value([])
        return self.rows[at]


LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace")))
