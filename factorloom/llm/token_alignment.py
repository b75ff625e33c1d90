"""Links between the tokens of two tokenizers over a corpus, and how often each pair is linked.

Both tokenizers read the text with one space before it. Byte offsets where tokens of both
end are cuts, and tokens between two cuts are a group. A token of A and one of B are linked
when their byte ranges end together. Then the shorter one's bytes end the longer one's, so
the pairs that can ever be linked follow from the two vocabularies alone (a token has no
more suffixes than bytes): that bounds every table of pairs here, whatever the corpus.

Neither tokenizer joins a single space between two other characters with what stands before
it, so texts are split there; the ends of such chunks are cuts, and the numpy steps run once
for each distinct chunk that a worker meets. Documents gather their chunks' figures.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.subwords import _FIRST, Subwords, byte_alphabet
from factorloom.llm.text_arrays import ranges, small_batches
from factorloom.shipping import ship

#: distinct chunks, and bytes of them, that a worker holds before its table starts anew
CHUNKS, HELD_BYTES = 500_000, 48_000_000
SALTS = 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^\s|\s$|\s\s")
_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_PAIRS = "b long, a long, n long"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks_of(text: str) -> list[str]:
    """Parts, none empty, that stand for themselves with a space before each; joined by spaces they are the text."""
    return _SAFE.split(text) if _ODD.search(text) else text.split(" ")


class ByteTokens(Subwords):
    """Tokenizer A; the strings of its special tokens are ordinary text."""

    def __init__(self, path: str | None = None):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, a space before each, and how many each has."""
        return self._encode_chunks([_FIRST + " " + c if c[0] == _FIRST else c for c in chunks])


class PieceTokens:
    """Tokenizer B, which puts the space before a text itself."""

    def __init__(self, path: str | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path or default_pieces())
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece joins a space with what stands before it")

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(chunks, num_threads=1)
        return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64)


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Codes (a << 32 | b), ascending, of all tokens of which one's bytes end the other's."""
    found = set()
    for long, short, code in ((a, b, lambda x, y: x << 32 | y), (b, a, lambda x, y: y << 32 | x)):
        ids: dict[bytes, list[int]] = {}
        for i, s in enumerate(short):
            ids.setdefault(s, []).append(i)
        for i, s in enumerate(long):
            for k in range(len(s)):
                found.update(code(i, j) for j in ids.get(s[k:], ()))
    return np.array(sorted(found), np.int64)


class Strings:
    """Byte strings by number, gathered many at a time."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.start[ids], self.length[ids])]


class Chunks(dict):
    """Numbers of chunks; a new one takes the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = number = len(self)
        return number


class Aligner:
    """A worker's table of chunks: sizes, links (places in ``pairs``) and groups of each."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.spelling_a, self.spelling_b = Strings(self.a.bytes), Strings(self.b.bytes)
        self.pairs = possible_pairs(self.a.bytes, self.b.bytes)
        #: how ids are written before each separator: those of A before , and |, those of B before , and ;
        sides = ((self.a, b","), (self.a, b"|"), (self.b, b","), (self.b, b";"))
        self.written = Strings([str(i).encode() + mark for t, mark in sides for i in range(len(t.bytes))])
        self.reset()

    def reset(self) -> None:
        self.index = Chunks()
        self.groups: list[bytes] = []
        self.held = 0
        #: columns: tokens of A, tokens of B, groups, links, whether both spell the chunk
        self.sizes = np.zeros((1 << 12, 5), np.int64)
        self.link_start = np.zeros(1 << 12, np.int64)
        self.links = np.zeros(1 << 14, np.int32)
        self.n_links = 0

    def align(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Sizes of each chunk, links of all and groups of each, as ``a1,a2|b1;a3|b2;``."""
        ids_a, count_a = self.a.encode_chunks(chunks)
        ids_b, count_b = self.b.encode_chunks(chunks)
        ids_a = ids_a.astype(np.int64)
        want = [b" " + c.encode() for c in chunks]
        size = np.array([len(w) for w in want], np.int64)
        same = self.spelled(self.spelling_a, ids_a, count_a, want, size) & self.spelled(self.spelling_b, ids_b, count_b, want, size)
        if not same.all():
            ids_a, ids_b = ids_a[np.repeat(same, count_a)], ids_b[np.repeat(same, count_b)]
        sizes = np.zeros((len(chunks), 5), np.int64)
        sizes[:, 0], sizes[:, 1], sizes[:, 4] = count_a * same, count_b * same, same
        ends_a, ends_b = np.cumsum(self.spelling_a.length[ids_a]), np.cumsum(self.spelling_b.length[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # tokens whose range ends at their group's cut, and all pairs of them in a group
        ending_a, ending_b = cuts[group_a] == ends_a, cuts[group_b] == ends_b
        last_a, last_b = np.flatnonzero(ending_a), np.flatnonzero(ending_b)
        times = np.bincount(group_b[last_b], minlength=len(cuts))[group_a[last_a]]
        first_b = np.searchsorted(group_b[last_b], group_a[last_a])
        left, right = np.repeat(ids_a[last_a], times), ids_b[last_b[ranges(first_b, times)]]
        links = np.searchsorted(self.pairs, left << 32 | right).astype(np.int32)
        chunk_ends = np.cumsum(size[same])
        owner = np.searchsorted(chunk_ends, cuts)
        sizes[same, 2] = np.bincount(owner, minlength=len(chunk_ends))
        sizes[same, 3] = np.bincount(owner[np.repeat(group_a[last_a], times)], minlength=len(chunk_ends))
        # each group's ids of A, then its ids of B, each with the separator that follows it
        n_a, n_b = len(self.spelling_a.length), len(self.spelling_b.length)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        codes = np.concatenate([ids_a + n_a * ending_a, 2 * n_a + ids_b + n_b * ending_b])[order]
        text = self.written.joined(codes).tobytes()
        tokens = np.append(0, np.cumsum(sizes[:, 0] + sizes[:, 1]))
        at = np.append(0, np.cumsum(self.written.length[codes]))[tokens].tolist()
        return sizes, links, [text[x:y] for x, y in zip(at, at[1:])]

    @staticmethod
    def spelled(strings: Strings, ids: np.ndarray, counts: np.ndarray, want: list[bytes], size: np.ndarray) -> np.ndarray:
        """Which chunks their tokens spell byte for byte."""
        tokens = np.append(0, np.cumsum(counts))
        at = np.append(0, np.cumsum(strings.length[ids]))[tokens]
        text = strings.joined(ids).tobytes()
        if (np.diff(at) == size).all() and text == b"".join(want):
            return np.ones(len(want), bool)
        return np.array([text[x:y] == w for x, y, w in zip(at.tolist(), at[1:].tolist(), want)], bool)

    def places(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's row of the table; unknown ones are added."""
        found = np.array(list(map(self.index.__getitem__, chunks)), np.int64)
        new = self.index.new
        if new:
            sizes, links, groups = self.align(new)
            n, m = len(self.groups), len(self.index)
            while m > len(self.sizes):
                self.sizes, self.link_start = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.link_start, np.zeros_like(self.link_start)])
            while self.n_links + len(links) > len(self.links):
                self.links = np.concatenate([self.links, np.zeros_like(self.links)])
            self.sizes[n:m] = sizes
            self.link_start[n:m] = self.n_links + np.cumsum(sizes[:, 3]) - sizes[:, 3]
            self.links[self.n_links : self.n_links + len(links)] = links
            self.n_links += len(links)
            self.groups += groups
            self.held += sum(map(len, new)) + sum(map(len, groups))
            self.index.new = []
        return found

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chunks of all texts, and each text's offset (with the end). Texts that a tokenizer does not spell have none."""
        if len(self.index) > CHUNKS or self.held > HELD_BYTES:
            self.reset()
        parts = [chunks_of(t) if t else [] for t in texts]
        place, at = self.places([c for p in parts for c in p]), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
        odd = np.add.reduceat(np.append(self.sizes[place, 4] == 0, 0), at[:-1]) * (np.diff(at) > 0) if len(texts) else np.zeros(0)
        if odd.any():
            # differences of two chunks could make up for each other: such texts are judged whole
            kept = [place[a:b] if not x else self.places([t]) for t, a, b, x in zip(texts, at, at[1:], odd)]
            kept = [p if len(p) != 1 or self.sizes[p[0], 4] else p[:0] for p in kept]
            place, at = np.concatenate(kept), np.append(0, np.cumsum([len(p) for p in kept])).astype(np.int64)
        return place, at

    def pair_counts(self, weights: np.ndarray) -> np.ndarray:
        """How often each pair is linked in so many occurrences of the table's chunks."""
        n = len(self.index)
        links, sizes = self.links[: self.n_links], self.sizes[:n, 3]
        return np.bincount(links, np.repeat(weights, sizes), len(self.pairs)).astype(np.int64)


def sums_between(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows from each place to the next."""
    sums = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])
    return sums[at[1:]] - sums[at[:-1]]


@lru_cache(maxsize=1)
def shared(path_a: str | None, path_b: str | None) -> Aligner:
    """The aligner of this process: tasks that follow one another in a worker find its chunks known."""
    return Aligner(path_a, path_b)


def token_pairs(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """b, a, n, best: each linked pair of ids, how many links of the corpus hold it, and whether no other pair of the B id has more.

    docs: text; other columns are ignored. A task counts its rows' pairs in one array and
    sends a row for each; sums go over a salted key first, so no pair's rows meet in one
    task before they are few. There are never more rows than ``possible_pairs``.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared(path_a, path_b)
        total = np.zeros(len(aligner.pairs), np.int64)
        for batch in small_batches(batches):
            place, _ = aligner.documents(batch["text"].to_pylist())
            total += aligner.pair_counts(np.bincount(place, minlength=len(aligner.index)))
        some = np.flatnonzero(total)
        codes = aligner.pairs[some]
        yield pa.RecordBatch.from_pydict({"b": codes & 0xFFFFFFFF, "a": codes >> 32, "n": total[some]})

    counted = docs.select("text").mapInArrow(count, _PAIRS)
    salted = counted.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("b", "a", "salt").agg(F.sum("n").alias("n"))
    pairs = salted.groupBy("b", "a").agg(F.sum("n").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    docs: doc_id, text; other columns are ignored. Null and empty texts, and texts that one
    of the tokenizers does not spell byte for byte, have no tokens: zeros and an empty
    groups_sha256. A null doc_id stays null; rows that repeat a doc_id or a text are rows
    each, and count as often as they occur. Very long texts are one row each and never cut.
    Ties: every pair that has its B id's highest count is a best one. An empty table gives
    no rows.

    The links' counts come back to the tasks as one broadcast array with a place for each
    possible pair, whose size the vocabularies bound (about 0.3 million places for the two
    public ones); the driver collects no more rows than that.
    """
    spark = docs.sparkSession
    ship(spark)
    found = token_pairs(docs, path_a, path_b).toArrow()  # bounded: see above
    sent = spark.sparkContext.broadcast((found["a"].to_numpy() << 32 | found["b"].to_numpy(), found["n"].to_numpy(), found["best"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared(path_a, path_b)
        known, n, best = sent.value
        at = np.searchsorted(aligner.pairs, known)
        total, top = np.zeros(len(aligner.pairs), np.int64), np.zeros(len(aligner.pairs), np.int64)
        total[at], top[at] = n, best
        for batch in small_batches(batches):
            place, at = aligner.documents(batch["text"].to_pylist())
            used, row = np.unique(place, return_inverse=True)
            sizes = aligner.sizes[used]
            links = aligner.links[ranges(aligner.link_start[used], sizes[:, 3])]
            of_links = sums_between(np.stack([top[links], total[links]], axis=1), np.append(0, np.cumsum(sizes[:, 3])))
            own = sums_between(np.concatenate([sizes[:, :4], of_links], axis=1)[row], at)
            places = place.tolist()
            digests = [hashlib.sha256(b"".join([aligner.groups[i] for i in places[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip(at.tolist(), at[1:].tolist())]
            names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {c: pa.array(own[:, k]) for k, c in enumerate(names)} | {"groups_sha256": pa.array(digests, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, _COLUMNS)
