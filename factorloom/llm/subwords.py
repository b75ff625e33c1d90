"""Ids of a public byte-level BPE tokenizer for many texts, by way of their chunks.

The tokenizer's pattern takes at most one space in front of a word, so a single space
between two non-spaces always starts a new token. Texts are split there, each distinct
chunk is encoded once, and ids are gathered by array indexing. Ids are those that
encoding the whole text gives.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from factorloom.llm.text_arrays import ranges

#: distinct chunks held in memory where no other number is given, beyond which the table starts anew; chunks encoded at a time
CHUNKS, TOGETHER = 700_000, 1000
#: letters up to which a text's blanks, were it all blanks, are no trouble to the faster encoder's pattern
WHOLE = 200_000
#: fixed value: the public tokenizer's splitting pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r" \s|\s ")
_OTHER = re.compile(r"[^\S \n]")
#: stands before a text's first chunk, which has no space before it
_FIRST = "\ufffe"
#: blanks beyond ASCII, which the encoders' patterns may take in different ways
_BLANK = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff\ufffe]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Subwords:
    """Encodes batches of texts; specials in a text are found as the tokenizer itself does."""

    def __init__(self, path: str | None = None, limit: int = CHUNKS):
        self._limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path or default_path())
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        special_ids = set(self.tokenizer.get_added_tokens_decoder())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self._opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self._opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the byte-level alphabet's space
        # the same merges in a faster encoder: a byte-level vocabulary numbers its tokens in the order of merging
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t) and i not in special_ids}
        self._plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self) -> None:
        self._index: dict[str, int] = {_FIRST: 0}
        self._flat, self._used = np.zeros(1 << 20, np.int32), 0
        self._start, self._size = np.zeros(self._limit * 2, np.int64), np.zeros(self._limit * 2, np.int64)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (as ``chunks`` gives them), one after the other, and how many each has.

        Chunks with one space, at their start, are encoded many at a time: there, an id
        whose bytes begin with a space begins a chunk.
        """
        chunks = [c[1:] if c[:1] == _FIRST else " " + c for c in chunks]
        plain = [i for i, c in enumerate(chunks) if c[0] == " " and c.count(" ") == 1 and len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        other = sorted(set(range(len(chunks))).difference(plain))
        got = [self._plain.encode_ordinary("".join(chunks[i] for i in plain[a : a + TOGETHER])) for a in range(0, len(plain), TOGETHER)]
        flat = np.concatenate([np.array(x, np.int32) for x in got]) if got else np.zeros(0, np.int32)
        opens = np.append(np.flatnonzero(self._opens[flat]), len(flat)) if len(flat) else np.zeros(1, np.int64)
        if len(opens) - 1 != len(plain):
            raise ValueError("the tokenizer joins a space with what stands before it")
        sizes = np.zeros(len(chunks), np.int64)
        sizes[plain] = np.diff(opens)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)]
        sizes[other] = [len(x) for x in rest]
        ids, at = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        ids[ranges(at[plain], sizes[plain])] = flat
        ids[ranges(at[other], sizes[other])] = np.array([i for x in rest for i in x], np.int32)
        return ids, sizes

    def _add(self, chunks: list[str]) -> None:
        room = len(self._index) + len(chunks)
        if room > len(self._start):
            self._start, self._size = (np.concatenate([a, np.zeros(room, np.int64)]) for a in (self._start, self._size))
        ids, sizes = self._encode_chunks(chunks)
        total = int(sizes.sum())
        while self._used + total > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + total] = ids
        at, n = len(self._index), len(chunks)
        self._start[at : at + n] = self._used + np.cumsum(sizes) - sizes
        self._size[at : at + n] = sizes
        self._used += total
        self._index.update(zip(chunks, range(at, at + n)))

    def chunks(self, text: str) -> list[str]:
        """Chunks whose ids do not depend on each other; all but the first stand without the space that begins them. The first is marked, or is the whole text."""
        if _FIRST in text or (self._special and self._special.search(text)):
            return [_FIRST + text]
        odd = "  " in text or "\n " in text or " \n" in text or (_OTHER.search(text) is not None and _ODD.search(text) is not None)
        parts = _SAFE.split(text) if odd else text.split(" ")
        parts[0] = _FIRST + parts[0]
        return parts

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """The 16-bit ids of each text, the same as ``encode`` gives: texts without blanks beyond ASCII go whole to the faster encoder, so chunks that seldom come again are not kept."""
        whole = [len(t) <= WHOLE and (t.isascii() or not _BLANK.search(t)) and not (self._special and self._special.search(t)) for t in texts]
        ids, at = self.encode([t for t, w in zip(texts, whole) if not w])
        others = iter([ids[a:b].astype(np.uint16) for a, b in zip(at, at[1:])])
        return [np.array(self._plain.encode_ordinary(t), np.uint16) if w else next(others) for t, w in zip(texts, whole)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and each text's offset (with the end)."""
        if len(self._index) > self._limit:
            self._reset()
        parts = [self.chunks(t) for t in texts]
        flat = [c for p in parts for c in p]
        index = self._index
        found = list(map(index.get, flat))
        if None in found:
            self._add(list({c: None for c, i in zip(flat, found) if i is None}))
            found = list(map(index.__getitem__, flat))
        place = np.array(found, np.int64)
        sizes = self._size[place]
        ids = self._flat[ranges(self._start[place], sizes)]
        at = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)]
        return ids, at


@lru_cache(maxsize=1)
def shared(path: str | None, limit: int = CHUNKS) -> Subwords:
    """The encoder of this process: tasks that follow one another in a worker find its chunks known. ``limit``: chunks that it holds."""
    return Subwords(path, limit)
