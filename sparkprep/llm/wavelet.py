"""Wavelet matrix over a run of numbers: one plane of bits per binary digit.

The highest digit comes first. Behind each plane the numbers are dealt to those
with a 0 there and then those with a 1, each in their order, so a number's place
in the next plane is a count of bits. Counts ahead of every block of 512 bits
are kept beside the planes; with them a number is read, counted and found
without reading the run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 512
_WORDS = BLOCK // 64
# Numbers that are dealt at once, so that their places stay in the cache.
_HAND = 1 << 15


@dataclass
class Plane:
    """Bits in 64-bit words (whole blocks, padded with 0), and the ones ahead of each block."""

    words: np.ndarray
    ahead: np.ndarray
    zeros: int

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        padded = np.zeros(-(-max(len(bits), 1) // BLOCK) * BLOCK // 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        words = padded.view(np.uint64)
        per_block = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint32)
        ahead = np.concatenate((np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)))
        return cls(words, ahead, len(bits) - int(ahead[-1]))

    def bits(self, n: int) -> np.ndarray:
        """All bits, as booleans."""
        return np.unpackbits(self.words.view(np.uint8), count=n, bitorder="little").view(bool)

    def at(self, places: np.ndarray) -> np.ndarray:
        word = self.words[places >> 6]
        return ((word >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def ones(self, places: np.ndarray) -> np.ndarray:
        """How many ones are ahead of each place (0 to the length)."""
        block = np.minimum(places // BLOCK, len(self.ahead) - 2)
        inside = (places - block * BLOCK)[:, None] - np.arange(_WORDS) * 64
        taken = np.clip(inside, 0, 64)
        mask = np.where(
            taken == 64,
            np.uint64(0xFFFFFFFFFFFFFFFF),
            (np.uint64(1) << (taken & 63).astype(np.uint64)) - np.uint64(1),
        )
        found = np.bitwise_count(self.words.reshape(-1, _WORDS)[block] & mask)
        return self.ahead[block].astype(np.int64) + found.sum(axis=1, dtype=np.int64)

    def find(self, ordinals: np.ndarray, bit: bool) -> np.ndarray:
        """Places of the ones (or zeros) with these numbers, from 0."""
        ahead = self.ahead.astype(np.int64)
        if not bit:
            ahead = np.arange(len(ahead)) * BLOCK - ahead
        block = np.searchsorted(ahead, ordinals, side="right") - 1
        words = self.words.reshape(-1, _WORDS)[block]
        seen = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little") == bit
        upto = np.cumsum(seen, axis=1, dtype=np.int16)
        inside = np.argmax(upto > (ordinals - ahead[block])[:, None], axis=1)
        return block * BLOCK + inside


def _dealt(run: np.ndarray, bits: np.ndarray, zeros: int) -> np.ndarray:
    """The numbers with a 0 and then those with a 1, each in their order."""
    out = np.empty_like(run)
    low, high = 0, zeros
    for start in range(0, len(run), _HAND):
        part, ones = run[start : start + _HAND], bits[start : start + _HAND]
        for chosen, at in ((np.compress(~ones, part), low), (np.compress(ones, part), high)):
            out[at : at + len(chosen)] = chosen
        high += int(np.count_nonzero(ones))
        low = start + len(part) - (high - zeros)
    return out


def _undealt(run: np.ndarray, bits: np.ndarray, zeros: int, digit: np.unsignedinteger) -> np.ndarray:
    """The numbers as they were before they were dealt, those with a 1 with the digit."""
    out = np.empty_like(run)
    low, high = 0, zeros
    for start in range(0, len(run), _HAND):
        part, ones = out[start : start + _HAND], bits[start : start + _HAND]
        there = np.flatnonzero(ones)
        part[there] = run[high : high + len(there)] | digit
        high += len(there)
        following = start + len(part) - (high - zeros)
        part[np.flatnonzero(~ones)] = run[low:following]
        low = following
    return out


@dataclass
class WaveletMatrix:
    """Numbers below 2 to the number of planes."""

    n: int
    planes: list[Plane]

    @classmethod
    def of(cls, numbers: np.ndarray, levels: int) -> WaveletMatrix:
        planes, run = [], numbers
        for level in range(levels - 1, -1, -1):
            bits = (run & run.dtype.type(1 << level)) != 0
            planes.append(Plane.of(bits))
            run = _dealt(run, bits, planes[-1].zeros)
        return cls(len(numbers), planes)

    def all(self) -> np.ndarray:
        """All numbers. Undoes the deals from the last plane to the first."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        run = np.zeros(self.n, dtype)
        for level, plane in enumerate(reversed(self.planes)):
            run = _undealt(run, plane.bits(self.n), plane.zeros, dtype(1 << level))
        return run

    def access(self, places: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        at, found = np.asarray(places, np.int64), np.zeros(len(places), np.uint32)
        for plane in self.planes:
            bits, ones = plane.at(at), plane.ones(at)
            found = (found << np.uint32(1)) | bits
            at = np.where(bits, plane.zeros + ones, at - ones)
        return found

    def _run(self, number: int, place: int) -> tuple[int, int]:
        """Where a number's run begins behind the last plane, and how far ``place`` is in it."""
        ends = np.array([0, place], np.int64)
        for level, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            ones = plane.ones(ends)
            ends = plane.zeros + ones if (number >> level) & 1 else ends - ones
        return int(ends[0]), int(ends[1] - ends[0])

    def count(self, number: int, place: int | None = None) -> int:
        """How often the number comes ahead of the place (by default: at all)."""
        if number >> len(self.planes):
            return 0
        return self._run(number, self.n if place is None else place)[1]

    def find(self, number: int) -> np.ndarray:
        """All places of the number, in order."""
        if number >> len(self.planes):
            return np.zeros(0, np.int64)
        start, n = self._run(number, self.n)
        at = np.arange(start, start + n)
        for level, plane in enumerate(reversed(self.planes)):
            bit = bool((number >> level) & 1)
            at = plane.find(at - plane.zeros if bit else at, bit) if n else at
        return at
