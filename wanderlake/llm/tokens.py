"""A table of what is known of each distinct word, kept inside a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class TokenTable(dict):
    """Word (bytes between ASCII white space) -> row of ``matrix``, which ``learn`` fills for unseen words.

    A text then costs one lookup a word, whatever ``learn`` does. Beyond ``limit`` words all are
    forgotten, so memory is bounded.
    """

    def __init__(self, width: int, learn: Callable[[list[bytes]], np.ndarray], dtype: type = np.float64, limit: int = 200_000):
        self.learn, self.limit = learn, limit
        self.matrix = np.zeros((1024, width), dtype)

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its words' rows of ``matrix``, in order."""
        words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        if len(self) > self.limit:
            self.clear()
        new = list(set().union(*words).difference(self))
        at, past = len(self), len(self) + len(new)
        if past > len(self.matrix):
            self.matrix = np.concatenate([self.matrix[:at], np.zeros((max(past, 2 * len(self.matrix)) - at, self.matrix.shape[1]), self.matrix.dtype)])
        for k in range(0, len(new), 50_000):
            self.matrix[at + k : at + min(k + 50_000, len(new))] = self.learn(new[k : k + 50_000])
        self.update(zip(new, range(at, past), strict=True))
        get = self.__getitem__
        return [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in words]
