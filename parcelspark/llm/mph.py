"""Minimal perfect hashing with stored keys, in whole-array steps.

``build`` places n distinct keys (rows of one or more 64-bit words) in slots 0 .. n - 1: bit arrays level by level, each holding the keys that met no other there, the rest
going to the next level. A key's slot is the number of set bits before its own. ``find`` compares every key with the one stored in its slot, so a key that is not of
the set gets -1, never a wrong slot. About 4 bits a key beside the keys themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np

from parcelspark.llm.common import mix

GAMMA = 2.0
_U = np.uint64


def hashes(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each key; for keys of one word no two are alike."""
    if keys.ndim == 1:
        return mix(keys + _U(0x9E3779B97F4A7C15))
    h = np.zeros(len(keys), _U)
    for j in range(keys.shape[1]):
        h = mix(h * _U(0x2545F4914F6CDD1D) + keys[:, j] + _U(j + 1))
    return h


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = mix(h ^ _U((level + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
    return (((spread >> _U(32)) * _U(size)) >> _U(32)).astype(np.int64)


@dataclass(frozen=True)
class Mph:
    sizes: list[int]  # bits of each level
    words: np.ndarray  # their bits, 64 a word
    before: np.ndarray  # set bits before each word
    keys: np.ndarray  # by slot

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = _place(h[todo], level, size)
            cell = base + (at >> 6)
            word, bit = self.words[cell], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            out[todo[hit]] = self.before[cell[hit]] + np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
            todo, base = todo[~hit], base + size // 64
        return out

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored; ``h`` are their ``hashes``."""
        out = self._slots(h)
        some = np.flatnonzero(out >= 0)
        same = self.keys[out[some]] == keys[some]
        out[some[~(same if keys.ndim == 1 else same.all(1))]] = -1
        return out


def build(keys: np.ndarray) -> Mph:
    """For distinct ``keys``. Raises ValueError where two keys of several words share all their hashes (of 64 bits)."""
    h = hashes(keys)
    if keys.ndim > 1 and len(np.unique(h)) < len(h):
        raise ValueError("two keys have one hash")
    left, sizes, words = np.arange(len(keys)), [], []
    for level in count():
        if not len(left):
            break
        size = 64 * max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = _place(h[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    words = np.concatenate(words) if words else np.zeros(0, _U)
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int64)
    out = Mph(sizes, words, before, keys)
    placed = np.empty_like(keys)
    placed[out._slots(h)] = keys
    return Mph(sizes, words, before, placed)
