"""Bit-sliced Hamming comparison of fingerprints, in NumPy, inside one bounded block."""

from __future__ import annotations

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits added before blocks of 64 fingerprints that are all too far are left out for the first time.
FIRST_LOOK = 24


def bit_planes(words: np.ndarray) -> np.ndarray:
    """(n, w) fingerprints of w 64-bit words -> (64 w, ceil(n / 64)): plane i holds bit i of all of them."""
    n, w = words.shape
    padded = np.zeros((-(-n // 64) * 64, w), dtype="<u8")
    padded[:n] = words
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


class _Counters:
    """A vertical counter for each lane. It starts so high that adding more than ``radius`` ones
    carries out of its top plane; ``over`` keeps that carry."""

    def __init__(self, radius: int, over: np.ndarray):
        size = max(int(radius).bit_length(), 2)
        start = (1 << size) - 1 - radius
        self.over = over
        self.planes = [np.full(over.shape, FULL if start >> i & 1 else 0, np.uint64) for i in range(size)]

    def _ripple(self, carry: np.ndarray, at: int) -> None:
        for i in range(at, len(self.planes)):
            plane = self.planes[i]
            self.planes[i], carry = plane ^ carry, plane & carry
        self.over |= carry

    def add(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Adds three difference planes: a carry-save adder makes one sum and one carry of them."""
        ab = a ^ b
        self._ripple((a & b) | (ab & c), 1)
        self._ripple(ab ^ c, 0)

    def take(self, at: tuple) -> None:
        self.over = self.over[at]
        self.planes = [plane[at] for plane in self.planes]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all fingerprints of ``left`` and ``right`` that differ in ``radius`` bits at most.

    ``left`` is met in runs of 256 against the planes of ``right``. Counters of 64 lanes that have all
    passed the radius are left out of the rest of the bits.
    """
    n, width = len(right), left.shape[1] * 64
    planes = bit_planes(right)
    lanes = planes.shape[1]
    pad = np.zeros(lanes, np.uint64)
    if n % 64:
        pad[-1] = FULL << np.uint64(n % 64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(left), 256):
        part = np.ascontiguousarray(left[start : start + 256], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").astype(bool)
        flip = np.where(bits, FULL, np.uint64(0))
        counters = _Counters(radius, np.broadcast_to(pad, (len(part), lanes)).copy())
        rows = cols = None
        for bit in range(0, width, 3):
            if rows is None:
                three = [planes[i] ^ flip[:, i, None] for i in range(bit, min(bit + 3, width))]
            else:
                three = [planes[i][cols] ^ flip[rows, i] for i in range(bit, min(bit + 3, width))]
            zero = np.zeros_like(three[0])
            counters.add(*three, *[zero] * (3 - len(three)))
            if bit + 3 >= FIRST_LOOK and (bit // 3) % 4 == 3:
                alive = np.nonzero(counters.over != FULL)
                if not len(alive[0]):
                    rows = alive[0]
                    break
                rows, cols = alive if rows is None else (rows[alive[0]], cols[alive[0]])
                counters.take(alive)
        if rows is None:
            alive = np.nonzero(counters.over != FULL)
            rows, cols = alive
            counters.take(alive)
        if len(rows):
            hits = np.unpackbits((~counters.over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(hits)
            found.append((rows[at] + start, cols[at] * 64 + lane))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all() and (root[a] == root[b]).all():
            return root
        root = new
