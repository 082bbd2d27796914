"""Encoding by distinct chunks: texts repeat their words, so each chunk is encoded once and looked up afterwards."""

from __future__ import annotations

from collections.abc import Callable


class ChunkCache:
    """Chunk -> encoded value, in two generations: when the young one is full, what was not used since then goes."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 250_000):
        self.encode_many, self.limit = encode_many, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, texts: list[list[str]]) -> dict[str, bytes]:
        """A mapping that holds every chunk of ``texts``."""
        used: set[str] = set()
        used.update(*texts)
        missing = [c for c in used if c not in self.young]
        if len(self.young) + len(missing) > self.limit:
            self.young, self.old = {}, self.young
            missing = list(used)
        old, young, new = self.old, self.young, []
        for c in missing:
            if c in old:
                young[c] = old[c]
            else:
                new.append(c)
        young.update(zip(new, self.encode_many(new)))
        return young
