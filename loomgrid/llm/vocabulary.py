"""What is known of the words that texts repeat, in a bounded store of each worker."""

from __future__ import annotations

from collections.abc import Callable

STORE = 500_000


class WordStore(dict):
    """What ``make`` gives for a word, kept for the next time.

    At most two generations of ``limit`` words are held: a full one becomes the old one, from
    which words still in use are taken over, and the rest goes. So a worker's memory is bounded
    whatever it reads. Words of 100 characters and more are not kept.
    """

    def __init__(self, make: Callable[[str], object], limit: int = STORE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str) -> object:
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        self.keep(word, made)
        return made

    def keep(self, word: str, made: object) -> None:
        if len(word) < 100:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = made
