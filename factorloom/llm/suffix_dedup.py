"""Exact substring removal by a depth-limited radix sort of suffixes.

Suffixes are ordered by most-significant-digit passes and only through ``length``
bytes. The digits are hashed byte blocks: the first pass distributes suffixes by an
anchor block of ``block`` bytes and drops groups of one, the next by the content
around it, the last by all ``length`` bytes. Groups that are still equal then are
exactly the repeated windows.

The first pass need not order every suffix: each window of ``length`` bytes is
represented by its least-hashed block (a minimizer), which equal windows share at the
same offset, so about 2 in (length - block) suffixes are sorted and none is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm.repeats import Runs, cut_repeats
from factorloom.llm.text_arrays import Rolling, byte_values, join_texts, mix, ranges

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: bits of a place in a bucket's bytes; keys compare by the bits above them
PLACE_BITS = 40
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key in each window of ``width``, the leftmost of equals (by the bits above PLACE_BITS)."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    tagged = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = tagged
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)


def byte_runs(texts: list[bytes], length: int, block: int) -> Runs:
    """Runs of windows of ``length`` bytes that share their minimizer block."""
    data, starts = join_texts(texts)
    rolling = Rolling(byte_values()[data])
    sizes = np.diff(starts) - 1
    counts = np.maximum(sizes - length + 1, 0)
    windows, doc = ranges(starts[:-1], counts), np.repeat(np.arange(len(texts)), counts)
    blocks = rolling.windows(block)
    place = sliding_argmin(blocks, length - block + 1)[windows] if len(windows) else windows
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(windows) else windows
    first, last = windows[new], windows[np.append(new[1:], len(windows)) - 1] if len(windows) else windows
    content = mix(rolling.slices(first, last + length) + (place[new] - first).astype(np.uint64))
    return Runs(first, last, doc[new], blocks[place[new]], content, lambda s: rolling.slices(s, s + length))


def remove_bytes(ids: list, texts: list[bytes], start: np.ndarray, end: np.ndarray) -> pa.Table:
    """The digest of each document without the bytes of the repeated intervals."""
    data, starts = join_texts(texts)
    gone = covered(len(data), start, end)
    gone[starts[1:] - 1] = True  # the newlines between texts
    kept, at = data[~gone].tobytes(), np.append(0, np.cumsum(~gone))[starts]
    opens = np.append(0, np.cumsum(gone & ~np.append(True, gone[:-1])))
    opens = np.diff(opens[starts])
    sizes = np.diff(starts) - 1
    # a text's first byte follows a newline, and the newline after a text opens no span of its own
    first = np.array([bool(n) and bool(gone[s]) for s, n in zip(starts, sizes)], np.int64)
    tail = np.array([bool(n) and not gone[e - 2] for e, n in zip(starts[1:], sizes)], np.int64)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()),
        "n_bytes": pa.array(sizes, pa.int64()),
        "n_removed": pa.array(sizes - np.diff(at), pa.int64()),
        "n_spans": pa.array(opens + first - tail, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
    })


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in an interval."""
    edges = np.bincount(start, minlength=n + 1).astype(np.int32) - np.bincount(end, minlength=n + 1).astype(np.int32)
    return np.cumsum(edges[:n]) > 0


def suffix_dedup(docs: DataFrame, length: int = 100, block: int = 36) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts earlier.

    docs: doc_id, text; other columns are ignored whatever their names. Null and empty
    texts give zeros and the hash of nothing; a null doc_id counts as later than all.
    Rows with one doc_id, and rows without, are taken in a fixed order by hash and then
    text, each later than the one before, so a repeated row of at least ``length`` bytes
    loses everything. An empty table gives no rows. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    return cut_repeats(docs, lambda t: byte_runs(t, length, block), remove_bytes, SCHEMA, length, same_doc=True)
