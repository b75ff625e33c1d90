"""Toxicity by compression distance: how much shorter does a window get with a toxic dictionary?

Two zstandard dictionaries are made from labelled training text: zstandard trains one on
ordinary text, and the other holds the same and, nearest its end, what toxic text has
beyond it. Each window of a text is compressed with both. Ordinary windows come out as long
with either; a window with toxic wording gets shorter with the toxic one. A logistic curve
over the gains, calibrated on training documents that the dictionaries have not seen, gives
the score.

A departure: zstandard does not choose the toxic dictionary's content. It keeps what is
frequent, and most of a toxic text's wording is as frequent in ordinary text; so stretches
of words are taken that toxic texts have far more often than ordinary ones.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.shipping import ship

#: labelled training documents of each label that are read at most, by hash of their id, and the most characters read of one: of a longer text, PIECES stretches evenly over its whole length
SAMPLE, SAMPLE_CHARS, PIECES = 3000, 32_768, 16
#: most bytes of a window, bytes from one window of a longer word to the next, and most bytes of each dictionary's share of ordinary text
WINDOW, STRIDE, ORDINARY_BYTES, TOXIC_BYTES = 64, 32, 8_192, 8_192
#: characters of the parts of words that are counted
PARTS = (4, 5, 6)
THRESHOLD = 0.3
#: how far a part's count in toxic texts must exceed what ordinary texts let expect, in standard deviations and as a ratio
LEAST_EXCESS, LEAST_RATIO = 6.0, 10.0
#: gains in bytes that are counted, and words whose gains a task remembers
STEPS, CACHE = (2, 3, 4, 5), 500_000
#: what stands around each window, and at the end of both dictionaries
FRAME = b" and for that whi ch with this are"


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # of the features, then the constant


def tokens(text: str) -> list[str]:
    return text.lower().split()


def windows_of(word: str) -> list[bytes]:
    """The word, or if it is long, overlapping windows over its whole length: text without spaces is one long word."""
    body = word.encode("utf-8", "replace")
    return [body[a : a + WINDOW] for a in range(0, len(body) - WINDOW + STRIDE, STRIDE)] if len(body) > WINDOW else [body]


def parts_of(word: str) -> set[str]:
    padded = " " + word
    return {padded[i : i + n] for n in PARTS for i in range(len(padded) - n + 1)}


def without_copies(texts: list[str]) -> list[str]:
    """The texts that share none of their least-hashed five-word shingles with an earlier one: a copied text's wording is no evidence twice."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = tokens(text)
        least = heapq.nsmallest(4, {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(len(words) - 4, 1))})
        if not seen.intersection(least):
            out.append(text)
        seen.update(least)
    return out


def toxic_stretches(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Stretches of words that toxic texts have far more often, the most telling last: in each such word, what its telling parts cover."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    words: set[str] = set()
    for label, texts in ((1, toxic), (0, ordinary)):
        for text in texts:
            own = set(tokens(text))
            if label:
                words |= own
            seen[label].update({p for w in own for p in parts_of(w)})
    n1, n0 = max(len(toxic), 1), max(len(ordinary), 1)
    telling = {}
    for part, a in seen[1].items():
        expected = n1 * (seen[0][part] + 0.5) / n0
        excess = (a - expected) / math.sqrt(expected + 0.25)
        if excess >= LEAST_EXCESS and a >= LEAST_RATIO * expected:
            telling[part] = excess
    scored: dict[str, float] = {}
    for word in words:
        padded = " " + word
        covered, best = [False] * len(padded), 0.0
        for n in PARTS:
            for i in range(len(padded) - n + 1):
                if (value := telling.get(padded[i : i + n])) is not None:
                    covered[i : i + n] = [True] * n
                    best = max(best, value)
        if best:
            stretch = "".join(c if k else "\n" for c, k in zip(padded, covered)).strip("\n")
            for piece in stretch.split("\n"):
                scored[piece] = max(scored.get(piece, 0.0), best)
    return [w for _, w in sorted((v, w) for w, v in scored.items() if w)]


class Gains:
    """Gains of windows. A window is one word or a part of a long one, set in a frame that both dictionaries hold: short windows keep a rare toxic word from drowning in its neighbours, the frame pays the format's fixed costs."""

    def __init__(self, model: Model):
        made = [zstandard.ZstdCompressionDict(d + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]
        parameters = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, window_log=16, hash_log=12, chain_log=12, search_log=4, min_match=3, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in made:
            d.precompute_compress(compression_params=parameters)
        self._ordinary, self._toxic = (zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress for d in made)
        self._weights = model.weights
        self._known: dict[str, tuple[int, ...]] = {}

    def gains(self, word: str) -> tuple[int, ...]:
        """Of each of the word's windows."""
        windows = [FRAME[:16] + b" " + w + FRAME[16:] for w in windows_of(word)]
        return tuple(len(self._ordinary(w)) - len(self._toxic(w)) for w in windows)

    def features(self, text: str) -> tuple[float, ...]:
        """How many windows gain at least so much, for each of STEPS (logarithms)."""
        known = self._known
        if len(known) > CACHE:
            known.clear()
        gains: Counter = Counter()
        for word, n in Counter(tokens(text)).items():
            found = known.get(word)
            if found is None:
                found = self.gains(word)
                if len(word) <= WINDOW:  # longer ones seldom come again
                    known[word] = found
            for g in found:
                gains[g] += n
        return tuple(math.log1p(sum(n for g, n in gains.items() if g >= s)) for s in STEPS)

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self._weights, (*self.features(text), 1.0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def dictionaries(texts: dict[int, list[str]]) -> tuple[bytes, bytes]:
    """Of ordinary text, and of the same and what toxic text has beyond it."""
    samples = [" ".join(tokens(t)).encode() for t in texts[0]]
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, samples, level=3).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on
        ordinary = b"\n".join(samples)[-ORDINARY_BYTES:] or b" the of and "
    beyond = "\n".join(toxic_stretches(without_copies(texts[1]), without_copies(texts[0]))).encode()
    return ordinary, ordinary + beyond[-TOXIC_BYTES:]


def fit(rows: list[tuple[int, str, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """rows: id, text, label. Every other document makes dictionaries on which the rest calibrate; all of them make the final ones. stands_for: how many labelled documents a row of label 0, and of label 1, stands for; so scores follow the labels' shares, not the sample's."""
    make, check = rows[::2], rows[1::2]
    trial = Model(*dictionaries({label: [t for _, t, y in make if y == label] for label in (0, 1)}), (0.0,) * (len(STEPS) + 1))
    gains = Gains(trial)
    x = np.array([(*gains.features(t), 1.0) for _, t, _ in check] or [(*[0.0] * len(STEPS), 1.0)])
    y = np.array([float(label) for _, _, label in check] or [0.0])
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    weight *= len(y) / weight.sum()
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * len(STEPS) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
    return Model(*dictionaries({label: [t for _, t, y in rows if y == label] for label in (0, 1)}), tuple(map(float, w)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` training rows of each label, which are weighted by how many there are of it; labels 0 and 1 of rows whose id is not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(is_training(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    ranked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]))  # 2 * sample rows of two numbers
    one = docs.select(F.col("doc_id").cast("long"), sampled("text").alias("text")).where("text is not null").join(chosen, "doc_id")
    rows = one.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # 2 * sample texts at most, none over SAMPLE_CHARS
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["text"]))
    return fit([(r["doc_id"], r["text"], r["toxic"]) for r in rows], tuple(max(there.get(y, 0) / sample, 1.0) for y in (0, 1)))


def sampled(text: str) -> Column:
    """The text, or of one over SAMPLE_CHARS characters PIECES stretches evenly over its whole length."""
    n, size = F.length(text), SAMPLE_CHARS // PIECES
    places = F.sequence(F.lit(0), F.lit(PIECES - 1))
    stretches = F.transform(places, lambda k: F.substring(F.col(text), (k * (n - size) / (PIECES - 1)).cast("int") + 1, F.lit(size)))
    return F.when(n <= SAMPLE_CHARS, F.col(text)).otherwise(F.array_join(stretches, " "))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. The score looks
    at the text alone. Null and empty texts get the score of a text without gains; so do
    all texts if there are no labels to learn from (then below the threshold). A null
    doc_id is scored and counts as not held out. Labels other than 0 and 1 teach nothing; of
    several labels of one id the highest counts, of several texts the first in order teaches.
    An empty table gives no rows. Whole texts are scored, whatever their length.
    """
    ship(docs.sparkSession)
    model = train(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model)
        for batch in batches:
            scores = [gains.score(text or "") for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns whatever their names.

    The text alone decides: rows with null or repeated ids are judged alike, and equal texts
    stay or go together. Null and empty texts stay if a text without gains scores below the
    threshold, as it does where most labels are 0. Without labels every row stays. An empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    model = train(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model)
        for batch in batches:
            mask = [gains.score(text or "") < threshold for text in batch["text"].to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
