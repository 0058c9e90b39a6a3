"""Byte-level vocabularies read from rank files, with the tables that merging and decoding need."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

from pathloom.llm.textbatch import mix, spread

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int64(1) << 40  # rank of a pair that never merges


class Vocab:
    """Tokens by rank. Two neighbouring symbols merge if their joined bytes are a token; its rank is the pair's rank and its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        by_id: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self._shift = np.uint64(64 - bits)
        self._mask = np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self._ranks = np.full(1 << bits, NONE)
        slot = (mix(keys) >> self._shift).astype(np.int64)
        values, todo = np.array(merged, np.int64), np.arange(len(keys))
        while todo.size:
            free = self._keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[todo][free], return_index=True)
            put = todo[free][one]
            self._keys[slot[put]], self._ranks[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self._mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE for one that never merges."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (mix(keys) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == keys, self._ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self._mask
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        return self.bytes[spread(self.starts[ids], self.lengths[ids])]


@lru_cache(4)
def load(path: str = DEFAULT_PATH) -> Vocab:
    """The vocabulary in a file of lines `base64-token rank`; read once in a process."""
    with open(path, "rb") as f:
        return Vocab({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
