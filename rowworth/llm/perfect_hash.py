"""A minimal perfect hash over 64-bit keys: levels of bits, each key alone at its bit, rank is the slot."""

from __future__ import annotations

import json
import struct

import numpy as np

from rowworth.llm.text import U64, mix

_GAMMA = 2


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    hashed = mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (((hashed >> U64(32)) * U64(size)) >> U64(32)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """slot(key) is a different number below len(keys) for each key it was built from."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        before, self._ranks = 0, []
        for bits in levels:
            self._ranks.append(before + np.concatenate([[0], np.cumsum(bits)]))
            before += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Keys must be distinct. Those that meet others at a level's bit go on to the next level."""
        levels = []
        while len(keys):
            places = _places(keys, len(levels), size := _GAMMA * len(keys) + 1)
            bits = np.bincount(places, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[places]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that are certainly none of those built from."""
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            places = _places(keys[left], level, len(bits))
            hit = bits[places]
            found[left[hit]] = self._ranks[level][places[hit]]
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        sizes = json.dumps([len(b) for b in self.levels]).encode()
        return struct.pack("<I", len(sizes)) + sizes + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash and how many bytes it took."""
        (long,) = struct.unpack_from("<I", raw)
        at, levels = 4 + long, []
        for size in json.loads(raw[4:at]):
            step = (size + 7) // 8
            packed = np.frombuffer(raw, dtype=np.uint8, count=step, offset=at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += step
        return cls(levels), at
