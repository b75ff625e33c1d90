"""Byte and word arrays of a batch of texts, with 64-bit polynomial hashes of any slice.

Every hash is a function of content alone (fixed tables, fixed bases), so the same
slice has the same hash in every task, partition and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE_BYTES = (9, 10, 11, 12, 13, 32)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64's last steps)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_values(lower: bool = False) -> np.ndarray:
    """The 256 random values that stand for bytes; with ``lower`` A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if lower:
        table[65:91] = table[97:123]
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of slices of an array of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(_U))

    def windows(self, size: int) -> np.ndarray:
        """The hash of each window of ``size`` values, by its start."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n] + _U(size))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one newline after each text, and where each text starts; null counts as empty."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    return np.frombuffer(b"".join(x for t in texts for x in (t or b"", b"\n")), np.uint8), starts


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: places in the joined bytes, hashes and first word of each text."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, hashes: bool = True):
        self.bytes, self.text_starts = join_texts(texts)
        space = np.zeros(256, bool)
        space[list(_SPACE_BYTES)] = True
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[1:] = ~space[self.bytes]
        edge = np.diff(inside)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.hashes = Rolling(byte_values(lower)[self.bytes]).slices(self.starts, self.ends) if hashes and len(self.starts) else np.zeros(0, _U)
        #: index of each text's first word, and the number of words at the end
        self.offsets = np.searchsorted(self.starts, self.text_starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes in ``column``; a longer value has a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
