"""Removal of word windows that a document with a smaller id also has, by recompression.

Rounds name runs of one word, then pairs of symbols, as in the recompression of words:
in each round a symbol's name decides on which side of a pair it may stand, so whether
two neighbours are paired depends on them alone (equal neighbours never are). A name is the hash of what it stands
for, so names are the same all over the corpus without a dictionary to look up. Equal
substrings then have equal symbols inside, whatever surrounds them; near their ends
symbols may depend on words outside, which each symbol's *reach* records.

A window is represented by the highest-level symbol whose reach lies inside it. Symbols
that no other document shares drop out; shared ones reveal candidates, which are
verified by their whole content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm.repeats import Runs, cut_repeats
from factorloom.llm.suffix_dedup import PLACE_BITS, covered
from factorloom.llm.text_arrays import Rolling, Words, mix, ranges

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ROUNDS = 3
_U = np.uint64
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_NONE = np.uint64((1 << 64) - 1)


def runs_round(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name runs of equal words: name, start, reach and document of each symbol. Where a run ends shows in its neighbours, so the reach takes them in."""
    n = len(name)
    heads = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.append(heads[1:], n)[: len(heads)]
    sizes = ends - heads
    named = np.where(sizes > 1, mix(name[heads] * _U(0x2545F4914F6CDD1D) + sizes.astype(_U)), name[heads])
    return named, heads, heads - 1, ends + 1, doc[heads]


def pairs_round(name: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Name pairs (left, right). A symbol left alone reaches to the neighbour that might have paired with it."""
    n = len(name)
    right = (mix(name + _U(level * 0x632BE59BD9B4E019 % (1 << 64))) >> _U(63)) == 1
    pair = np.append(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]), False)
    nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    named = np.where(pair, mix(name * _U(0x9FB21C651E98DF25) + mix(name[nxt] + _U(level))), name)
    other = np.where(right, prv, nxt)
    other = np.where(doc[other] == doc, other, np.arange(n))  # at a text's end the reach lies outside it already
    keep = ~np.append(False, pair[:-1])
    return named[keep], start[keep], np.minimum(low, low[other])[keep], np.maximum(high, high[other])[keep], doc[keep]


def word_runs(texts: list[bytes], size: int, rounds: int = ROUNDS) -> Runs:
    """Runs of windows of ``size`` words that one symbol represents."""
    if not 0 < size < 1 << 14:
        raise ValueError("a window has from 1 to 16383 words")
    words = Words(texts)
    n = len(words.hashes)
    rolling = Rolling(words.hashes)
    counts = np.maximum(words.counts - size + 1, 0)
    windows, doc = ranges(words.offsets[:-1], counts), np.repeat(np.arange(len(texts)), counts)
    text_of = np.repeat(np.arange(len(texts)), words.counts)
    place = np.arange(n)
    symbols = (words.hashes, place, place, place + 1, text_of)
    levels = [symbols]
    for level in range(1, rounds + 1):
        symbols = pairs_round(*(runs_round(words.hashes, text_of) if level == 1 else symbols), level) if n else symbols
        levels.append(symbols)

    # the highest level that has a symbol inside, and of that the least by hash, the leftmost of equals
    m = max(n - size + 1, 0)
    best, level_at = np.full(m, _NONE), np.zeros(m, np.int8)
    names = []
    for level in range(rounds, -1, -1):
        name, start, low, high, _ = levels[level]
        rank, before, after = np.full(n, _NONE), np.full(n, -size, np.int16), np.full(n, size + 1, np.int16)
        rank[start] = (mix(name + _U(level)) & ~_PLACE) | start.astype(_U)
        before[start] = np.maximum(low - start, -size)
        after[start] = np.minimum(high - start, size + 1)
        names.append((start, name))
        least = np.full(m, _NONE)
        for shift in range(size if m else 0):
            s = slice(shift, shift + m)
            inside = (before[s] >= -shift) & (after[s] <= size - shift)
            np.minimum(least, np.where(inside, rank[s], _NONE), out=least)
        without = best == _NONE
        best[without] = least[without]
        level_at[without] = level
        if not (best[windows] == _NONE).any():
            break
    at, level_of = (best[windows] & _PLACE).astype(np.int64), level_at[windows].astype(np.int64)
    tag = at * (rounds + 1) + level_of
    new = np.flatnonzero(np.append(True, tag[1:] != tag[:-1])) if len(windows) else windows
    first, last = windows[new], windows[np.append(new[1:], len(windows)) - 1] if len(windows) else windows
    anchor = np.zeros(len(new), _U)
    for level, (start, name) in zip(range(rounds, -1, -1), names):
        of = np.flatnonzero(level_of[new] == level)
        anchor[of] = name[np.searchsorted(start, at[new[of]])]
    anchor = mix(anchor + level_of[new].astype(_U))
    content = mix(rolling.slices(first, last + size) + (at[new] - first).astype(_U))
    return Runs(first, last, doc[new], anchor, content, lambda s: rolling.slices(s, s + size))


def remove_words(ids: list, texts: list[bytes], start: np.ndarray, end: np.ndarray) -> pa.Table:
    """The digest of each document without the words of the repeated intervals."""
    words = Words(texts, hashes=False)
    gone = covered(len(words.starts), start, end)
    data = words.bytes.copy()
    data[words.ends] = 32
    start, end = words.starts[~gone], words.ends[~gone] + 1  # each kept word and the space after it
    mask = covered(len(data), start, end)
    kept, at = data[mask].tobytes(), np.append(0, np.cumsum(mask))[words.text_starts]
    left = np.append(0, np.cumsum(~gone))[words.offsets]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()),
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(words.counts - np.diff(left), pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
    })


def substring_dedup(docs: DataFrame, size: int = 13, rounds: int = ROUNDS) -> DataFrame:
    """Remove each word that a window of ``size`` words covers whose words also start in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored whatever their names. Null and empty
    texts have no words and the hash of nothing; a null doc_id counts as larger than
    all. Rows with one doc_id never remove words from each other. An empty table gives
    no rows. Returns doc_id, n_words, n_removed, kept_sha256.
    """
    return cut_repeats(docs, lambda t: word_runs(t, size, rounds), remove_words, SCHEMA, size, same_doc=False)
