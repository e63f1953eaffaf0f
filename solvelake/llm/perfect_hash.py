"""Minimal perfect hashes of byte strings, with the strings, so that others are told apart."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import xxhash

from solvelake.llm.hashing import U, mix

LEVELS = 24


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """64 bits of each key: what Spark's ``xxhash64`` gives for a binary, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), U, len(keys))


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 for n keys.

    A key stands at its position of the first level where no other key that came so far shares it; its slot is the
    number of positions taken before. ``rest`` has the keys that share all 64 bits with another.
    """

    sizes: list[int]
    words: np.ndarray
    before: np.ndarray
    text: bytes
    ends: np.ndarray
    rest: dict[bytes, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.ends)

    def key(self, slot: int) -> bytes:
        return self.text[self.ends[slot - 1] if slot else 0 : self.ends[slot]]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The slot that each hash leads to, -1 for none; only the stored key tells whether it is the same key."""
        out = np.full(len(hashes), -1, np.int64)
        open_, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = _position(hashes[open_], level, size) + base
            word = self.words[at >> 6]
            bit = (at & 63).astype(U)
            hit = word >> bit & U(1) == 1
            low = word & ((U(1) << bit) - U(1))
            out[open_[hit]] = (self.before[at >> 6] + np.bitwise_count(low))[hit]
            open_, base = open_[~hit], base + size
        return out

    def slots(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are not among the stored ones."""
        out = self.places(hashes)
        text, starts = self.text, np.append(0, self.ends)
        for k, (key, slot, a, b) in enumerate(
            zip(keys, out.tolist(), starts[out].tolist(), starts[out + 1].tolist(), strict=True)
        ):
            if slot < 0 or text[a:b] != key:
                out[k] = self.rest.get(key, -1)
        return out


def _position(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U(size)).astype(np.int64)


def build(keys: list[bytes]) -> PerfectHash:
    """A perfect hash of different ``keys``."""
    hashes = hash_keys(keys)
    _, same, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    alike = counts[same] > 1
    open_, sizes, taken, owner, base = np.flatnonzero(~alike), [], [], [], 0
    while len(open_) and len(sizes) < LEVELS:
        size = -(-3 * len(open_) // 128) * 64
        at = _position(hashes[open_], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        taken.append(at[alone] + base)
        owner.append(open_[alone])
        open_, base = open_[~alone], base + size
        sizes.append(size)
    places, owners = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (taken, owner))
    order = np.argsort(places)
    bits = np.zeros(base, bool)
    bits[places] = True
    words = np.packbits(bits, bitorder="little").view("<u8") if base else np.zeros(0, U)
    before = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)
    ordered = [keys[k] for k in owners[order].tolist()]
    left = [keys[k] for k in np.concatenate([np.flatnonzero(alike), open_]).tolist()]
    rest = {key: len(ordered) + k for k, key in enumerate(left)}
    ordered += left
    ends = np.cumsum([len(k) for k in ordered], dtype=np.int64)
    return PerfectHash(sizes, words, before, b"".join(ordered), ends, rest)


def dump(table: PerfectHash) -> bytes:
    return pickle.dumps(table)


def load(raw: bytes) -> PerfectHash:
    return pickle.loads(raw)
