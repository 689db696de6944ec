"""Words of many texts as numbers, with what is worked out once for each distinct word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count, islice

import numpy as np


class WordTable:
    """codes() numbers the words of texts; facts holds one row for each number, by fact(list of words)."""

    def __init__(self, fact: Callable[[list[bytes]], np.ndarray], most: int = 400_000):
        self.fact, self.most = fact, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict = defaultdict(count().__next__)
        self.facts = self.fact([])

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in a row, and the number of words of each text."""
        if len(self.index) > self.most:
            self._clear()
        known, get = len(self.index), self.index.__getitem__
        out = []
        for t in texts:
            words = t.split()
            out.append(np.fromiter(map(get, words), np.int64, len(words)))
        if len(self.index) > known:
            self.facts = np.concatenate([self.facts, self.fact(list(islice(self.index, known, None)))])
        return np.concatenate(out) if out else np.empty(0, np.int64), np.fromiter(map(len, out), np.int64, len(out))
