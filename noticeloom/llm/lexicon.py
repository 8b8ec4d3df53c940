"""Words as small numbers inside a task, so that work on a word is done once, not at each use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Distinct words that a task keeps before it starts again.
MOST_WORDS = 150_000
#: Texts split at a time.
BLOCK = 256


class Lexicon:
    """`on_new(words)` appends what the caller keeps per word; `on_reset()` empties it."""

    def __init__(self, on_new: Callable[[list], None], on_reset: Callable[[], None], limit: int = MOST_WORDS):
        self.number: dict = {}
        self.on_new, self.on_reset, self.limit = on_new, on_reset, limit

    def ids(self, texts: list, split: Callable[[object], list]) -> Iterator:
        """For each text an array of its words' numbers, good until the next one is asked for.

        Texts are split a block at a time, so the words of a whole batch never stand in memory.
        """
        import numpy as np

        for at in range(0, len(texts), BLOCK):
            block = [split(t) for t in texts[at : at + BLOCK]]
            if len(self.number) > self.limit:
                self.number.clear()
                self.on_reset()
            new = [w for w in set().union(*block) if w not in self.number]
            if new:
                self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
                self.on_new(new)
            get = self.number.__getitem__
            for words in block:
                yield np.fromiter(map(get, words), np.int64, len(words))


class Rows:
    """A matrix that grows by blocks of rows."""

    def __init__(self, width: int, kind="f8"):
        import numpy as np

        self.rows, self.n = np.zeros((1024, width), kind), 0

    def add(self, block) -> None:
        import numpy as np

        if self.n + len(block) > len(self.rows):
            more = np.zeros((max(2 * len(self.rows), self.n + len(block)), self.rows.shape[1]), self.rows.dtype)
            more[: self.n] = self.rows[: self.n]
            self.rows = more
        self.rows[self.n : self.n + len(block)] = block
        self.n += len(block)
