"""Word and line hashing of whole Arrow text columns in numpy, without a Python string per word.

Texts are read as UTF-8 bytes. A word is a run of bytes other than space and 0x09-0x0D, a line is what
stands between newlines. A run's hash is a polynomial over random byte values modulo 2^64, taken from
prefix sums, so every word of a block is hashed in a few array operations. Texts are taken in blocks of
`BLOCK` bytes; one longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240607)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept between blocks."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK + 65536)
        with np.errstate(over="ignore"):
            for name, factor in (("up", BASE), ("down", INVERSE)):
                table = np.full(size, factor, dtype=np.uint64)
                table[0] = 1
                _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Runs:
    """Runs of bytes of a block, in order: text number in the block, byte range in the block, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


@dataclass
class Block:
    """Consecutive texts of a column: `first` is the row number of the first, `bounds` their byte offsets."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def size(self) -> int:
        return len(self.bounds) - 1

    def prefix(self) -> np.ndarray:
        up, _ = _powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUE[self.data] * up[:len(self.data)], out=total[1:])
        return total

    def hashes(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hash of each byte range; equal ranges have equal hashes."""
        prefix = self.prefix() if prefix is None else prefix
        _, down = _powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def code_points(self) -> np.ndarray:
        """Code points before each byte."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total

    def _split(self, is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~is_break
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        first = self.bounds[:-1]
        before[first[first < len(inside)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = self.bounds[1:] - 1
        after[last[last >= 0]] = False
        return start, np.flatnonzero(inside & ~after) + 1

    def words(self, prefix: np.ndarray | None = None) -> Runs:
        start, end = self._split(SPACE[self.data])
        doc = np.searchsorted(self.bounds, start, side="right") - 1
        return Runs(doc, start, end, self.hashes(start, end, prefix))

    def lines(self, prefix: np.ndarray | None = None) -> Runs:
        """Every non-empty line."""
        start, end = self._split(self.data == 0x0A)
        doc = np.searchsorted(self.bounds, start, side="right") - 1
        return Runs(doc, start, end, self.hashes(start, end, prefix))


def blocks(column: pa.Array, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow string column in blocks of `size` bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        part = raw[bounds[at]:bounds[to]]
        yield Block(at, LOWER[part] if lower else part, bounds[at:to + 1] - bounds[at])
        at = to


def per_doc(size: int, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sum of `weight` (or the count) per text."""
    if weight is None:
        return np.bincount(doc, minlength=size).astype(np.int64)
    return np.bincount(doc, weights=weight, minlength=size).astype(np.int64)
