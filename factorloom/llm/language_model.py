"""Language-model scores: corpus-wide word counts, and a causal self-attention model on subword ids.

Three things are gathered from all training documents: counts of words (for the base
score), counts of subword ids, and counts of ids by what stands before them. Classes are
the commonest ids, one each, and bands of the rest by count; contexts are the same, with
more of the commonest ids apart. The model predicts the next id's class from attention over
a window of earlier ids, on top of the corpus-wide odds of classes that follow one another,
and then the id within its class by how often it follows the context of the id before. An
id is embedded as what its class has and what it has of its own, which starts at nothing.
The attention is trained in numpy by the tasks that hold the text, on all its windows;
their averaged weights are the model.

Windows overlap: each scores STEP ids, once, and sees CONTEXT ids before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import blobs
from factorloom.llm.components import saved
from factorloom.llm.text_arrays import Words, small_batches
from factorloom.shipping import ship

#: ids that a window scores, ids before them that it sees, classes, width of the attention
STEP, CONTEXT, CLASSES, WIDTH = 32, 16, 48, 16
SPAN = STEP + CONTEXT
#: classes that are bands of rarer ids, contexts, and the weight of an id's share of its class beside what follows a context
BANDS, CONTEXTS, SMOOTH = 16, 128, 20.0
#: ids that numbers of 16 bits can tell
IDS = 1 << 16
#: windows in a step of learning; ids from which a task learns at least, if there are so many
TRAIN_BATCH, RATE, TRAIN_IDS = 192, 0.02, 2_000_000
SCORE_BATCH = 192
#: first step of an id's own embedding; later ones follow from the sizes of its gradients
ID_RATE = 0.3
#: rows of weights that are averaged together, and parts in which tasks' sums are added up first
ROWS, FAN = 512, 256
END_WORD = np.array([0x5EED_E4D0_0000_0001], np.uint64)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1


class Classes:
    """Class and context of each id, and an id's share of its class. A context is part of one class."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.of = np.zeros(len(counts), np.uint8)
        heads = CLASSES - BANDS
        self.of[order[:heads]] = np.arange(heads)
        rest = order[heads:]
        mass = np.cumsum(counts[rest] + 0.5)
        self.of[rest] = heads + np.minimum((mass - 1e-9) * BANDS // mass[-1], BANDS - 1).astype(np.int64)
        smooth = counts + 0.5
        self.share = (smooth / np.bincount(self.of, smooth, CLASSES)[self.of]).astype(np.float32)
        own = CONTEXTS - BANDS
        self.context = (self.of.astype(np.int64) - heads + own).astype(np.uint8)
        self.context[order[:own]] = np.arange(own)
        #: class of each context; the last context and class stand before a text
        self.of_context = np.full(CONTEXTS + 1, CLASSES, np.uint8)
        self.of_context[self.context] = self.of

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The context before each id of texts that begin at ``starts``."""
        before = np.append(np.uint8(CONTEXTS), self.context[ids[:-1]])
        before[starts] = CONTEXTS
        return before

    def odds(self, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of classes' odds after each class, and of ids' odds within their class after each context. following: counts, contexts by ids."""
        pairs = np.zeros((CLASSES + 1, CLASSES))
        inside = np.empty(following.shape, np.float32)
        for c, n in enumerate(following):
            by_class = np.bincount(self.of, n, CLASSES)
            pairs[self.of_context[c]] += by_class
            inside[c] = np.log((n + SMOOTH * self.share) / (by_class + SMOOTH)[self.of])
        alone = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
        return np.log((pairs + 20 * alone) / (pairs.sum(axis=1, keepdims=True) + 20)), inside


class Attention:
    """One layer of causal self-attention over ids, whose classes it predicts. of: each id's class (by default ids are classes). The id ``before`` stands before a text."""

    #: rows of WIDTH numbers: embeddings of classes; queries', keys' and values' projections; odds; nearness. Those of ids follow.
    SHAPES = {"class": (CLASSES + 1, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "out": (WIDTH, CLASSES), "near": (SPAN,)}
    SHARED = sum(math.prod(x) for x in SHAPES.values()) // WIDTH

    def __init__(self, follow: np.ndarray, rows: np.ndarray | None = None, of: np.ndarray | None = None):
        self.follow = follow.astype(np.float32)  # logarithm of a class's odds after each class
        self.of = np.arange(CLASSES, dtype=np.uint8) if of is None else of
        self.before = min(len(self.of), (1 << 16) - 1)
        self._input = np.append(self.of, np.uint8(CLASSES))  # classes of ids that are seen; a text's last id is not
        self._input[self.before] = CLASSES
        rng = np.random.default_rng(0)
        if rows is None:
            rows = np.zeros((self.SHARED + self.before + 1, WIDTH), np.float32)
            rows[: CLASSES + 1] = rng.normal(0, 0.5, (CLASSES + 1, WIDTH))
            rows[CLASSES + 1 : CLASSES + 1 + 3 * WIDTH] = rng.normal(0, 0.15, (3 * WIDTH, WIDTH))
        self.rows = rows
        self.w, at = {"id": rows[self.SHARED :]}, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape) // WIDTH
            self.w[name] = rows[at : at + n].reshape(shape)  # a view
            at += n
        self._steps = {n: [np.zeros_like(x), np.zeros_like(x)] for n, x in self.w.items() if n != "id"}
        self._size = np.zeros(len(self.w["id"]), np.float32)  # of an id's gradients so far, squared
        self._t = 0
        self._known: np.ndarray | None = None  # queries, keys and values of all ids, while the weights stay as they are
        #: windows learnt from, and for each id steps in which it was seen
        self.n, self.met = 0, np.zeros(len(self.w["id"]), np.int64)
        query, key = np.arange(STEP)[:, None] + CONTEXT - 1, np.arange(SPAN - 1)[None, :]
        self._gap = np.maximum(query - key, 0)
        self._seen = key <= query
        # sums over rows of an array come sooner as products
        self._held: dict[str, np.ndarray] = {}
        self._keys, self._classes = np.ones((SPAN - 1, 1), np.float32), np.ones((CLASSES, 1), np.float32)

    def embedded(self, seen: np.ndarray) -> np.ndarray:
        at = seen.ravel()
        x = self.w["class"].take(self._input.take(at), axis=0, out=self._room("x", at.size, WIDTH), mode="clip")  # with "raise", a copy would be made
        x += self.w["id"].take(at, axis=0, out=self._room("own", at.size, WIDTH), mode="clip")
        return x.reshape(*seen.shape, WIDTH)

    def _room(self, name: str, n: int, *shape: int) -> np.ndarray:
        """An array that the next step writes over; taking new memory for each step costs more than its sums."""
        if name not in self._held or len(self._held[name]) < n:
            self._held[name] = np.zeros((n, *shape), np.float32)
        return self._held[name][:n]

    def near(self) -> np.ndarray:
        """What nearness adds for each query and key; keys that come later are not seen."""
        return np.where(self._seen, self.w["near"][self._gap], np.float32(-1e9))

    def attend(self, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        """seen: ids of windows but for their last one. Embeddings, queries, keys, values, weights, their sums and what they gather."""
        x = None
        if self._known is None:
            x = self.embedded(seen)
            qkv = np.matmul(x.reshape(-1, WIDTH), self.w["qkv"], out=self._room("qkv", seen.size, 3 * WIDTH))
        else:
            qkv = self._known.take(seen.ravel(), axis=0, out=self._room("qkv", seen.size, 3 * WIDTH), mode="clip")
        qkv = qkv.reshape(*seen.shape, 3 * WIDTH)
        q, k, v = qkv[:, CONTEXT - 1 :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
        s = np.matmul(q, k.transpose(0, 2, 1), out=self._room("s", len(seen), STEP, SPAN - 1))
        s += self.near()
        bounded_exp(s, 30)
        sums = np.matmul(s, self._keys)
        a = np.matmul(s, v)
        a /= sums
        return x, q, k, v, s, sums, a

    def odds(self, windows: np.ndarray, gathered: np.ndarray) -> np.ndarray:
        z = np.matmul(gathered.reshape(-1, WIDTH), self.w["out"], out=self._room("z", len(windows) * STEP, CLASSES))
        z += self.follow.take(self._input.take(windows[:, CONTEXT - 1 : -1].ravel()), axis=0, out=self._room("follow", len(z), CLASSES), mode="clip")
        return z

    def targets(self, windows: np.ndarray) -> np.ndarray:
        return self.of[np.minimum(windows[:, CONTEXT:].ravel(), len(self.of) - 1)]

    def score(self, windows: np.ndarray) -> np.ndarray:
        """Logarithm of the odds of each scored id's class."""
        if self._known is None:
            self._known = self.embedded(np.arange(self.before + 1)) @ self.w["qkv"]
        z = self.odds(windows, self.attend(windows[:, :-1])[-1])
        picked = z[np.arange(len(z)), self.targets(windows)]
        bounded_exp(z, 60)
        return (picked - np.log(np.matmul(z, self._classes)[:, 0])).reshape(len(windows), STEP)

    def gradients(self, windows: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of shared weights, and of what each id but a window's last is embedded as. weight: of each scored id."""
        x, q, k, v, s, sums, a = self.attend(windows[:, :-1])
        z = self.odds(windows, a)
        bounded_exp(z, 60)
        z *= weight[:, None] / np.matmul(z, self._classes)
        z[np.arange(len(z)), self.targets(windows)] -= weight
        grad = {"out": a.reshape(-1, WIDTH).T @ z}
        da = np.matmul(z, self.w["out"].T, out=self._room("da", len(z), WIDTH)).reshape(a.shape)
        da /= sums  # weights are s / sums
        ds = np.matmul(da, v.transpose(0, 2, 1), out=self._room("ds", len(windows), STEP, SPAN - 1))
        ds -= np.einsum("bsw,bsw->bs", da, a)[:, :, None]
        ds *= s
        d = self._room("d", len(windows), SPAN - 1, 3 * WIDTH)  # the first keys are no queries: there it stays 0
        d[:, CONTEXT - 1 :, :WIDTH] = np.matmul(ds, k)
        d[:, :, WIDTH : 2 * WIDTH] = np.matmul(ds.transpose(0, 2, 1), q)
        d[:, :, 2 * WIDTH :] = np.matmul(s.transpose(0, 2, 1), da)
        d = d.reshape(-1, 3 * WIDTH)
        grad["near"] = np.bincount(self._gap.ravel(), (ds.sum(axis=0) * self._seen).ravel(), SPAN).astype(np.float32)
        grad["qkv"] = x.reshape(-1, WIDTH).T @ d
        return grad, np.matmul(d, self.w["qkv"].T, out=self._room("dx", len(d), WIDTH))

    def learn(self, windows: np.ndarray, real: np.ndarray) -> None:
        """One step on the scored ids that are real: of Adam, and of Adagrad for ids' own embeddings, of which a step sees few."""
        self._known = None
        grad, of_seen = self.gradients(windows, (real.ravel() / max(real.sum(), 1)).astype(np.float32))
        seen, of_ids = summed(windows[:, :-1].ravel(), of_seen)
        grad["class"] = np.zeros_like(self.w["class"])
        classes, of_classes = summed(self._input[seen], of_ids)
        grad["class"][classes] = of_classes
        self.n += len(windows)
        self.met[seen] += 1
        self._t += 1
        for name, g in grad.items():
            m, s = self._steps[name]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            self.w[name][...] -= RATE * (m / (1 - 0.9**self._t)) / (np.sqrt(s / (1 - 0.99**self._t)) + 1e-6)
        size = self._size[seen] + np.einsum("nw,nw->n", of_ids, of_ids) / WIDTH
        self._size[seen] = size
        self.w["id"][seen] -= (ID_RATE / (np.sqrt(size) + 1e-8))[:, None] * of_ids

    def learnt(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have learnt something, and the weight of each: of an id's, the steps that saw it."""
        weight = np.append(np.full(self.SHARED, self.n), self.met)
        rows = np.flatnonzero(weight)
        return rows, weight[rows]


def bounded_exp(x: np.ndarray, most: float) -> None:
    """e to the power of each number, or of ``most`` where that is less, in its place."""
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)
    np.exp(x, out=x)


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``at``, ascending, and the sum of each one's rows."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return at[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def windows_of(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, before: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text of each, and which of their scored ids are real. ids: those of all texts, one text after the other."""
    counts = -(-sizes // STEP)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    place = first[:, None] + np.arange(-CONTEXT, STEP)[None, :]
    inside = (place >= 0) & (place < sizes[text][:, None])
    windows = np.full(place.shape, before, np.uint16)
    windows[inside] = ids[(starts[text][:, None] + place)[inside]]
    return windows, text, inside[:, CONTEXT:]


def pack_ids(ids: np.ndarray) -> bytes:
    """16-bit ids, all low bytes before all high ones, compressed."""
    return _deflate(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 2).T).tobytes())


def unpack_ids(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_inflate(body), np.uint8).reshape(2, -1).T).view(np.uint16).ravel()


def _deflate(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _inflate(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def batch_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, how many each has and where they start."""
    parts = [unpack_ids(b) for b in batch["ids"].to_pylist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts), sizes, np.cumsum(sizes) - sizes


def teach(model: Attention, batches: Iterator[pa.RecordBatch]) -> None:
    """Learns from every window of the batches, in steps of TRAIN_BATCH and a last one of what remains. batches: h, ids."""
    held = []
    for batch in small_batches(batches, 500_000, "ids"):
        ids, sizes, starts = batch_ids(batch)
        windows, text, real = windows_of(ids, sizes, starts, model.before)
        marks = np.array(batch["h"].to_pylist(), np.int64)[text] * 31 + np.arange(len(text)) - np.searchsorted(text, text)
        mixed = np.argsort(marks * np.int64(0x9E3779B97F4A7C15 - (1 << 64)), kind="stable")  # a step's windows are of many texts
        held.append((windows[mixed], real[mixed]))
        w, r = (np.concatenate(x) for x in zip(*held))
        cut = len(w) // TRAIN_BATCH * TRAIN_BATCH
        for a in range(0, cut, TRAIN_BATCH):
            model.learn(w[a : a + TRAIN_BATCH], r[a : a + TRAIN_BATCH])
        held = [(w[cut:], r[cut:])]
    if held and len(held[0][0]):
        model.learn(*held[0])


def base_scores(rows: DataFrame, n_docs: int, n_keys: int) -> DataFrame:
    """doc_id, h, n_tokens, n_known, train_tokens, base_score, by an exchange of word counts. rows: doc_id, text, h, held_out."""
    docs = rows.withColumn("src", blobs.row_bucket(n_docs))

    def word_keys(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order, words' hashes with each text's end, their texts, and which texts teach."""
        table = table.sort_by([("doc_id", "ascending"), ("h", "ascending")])
        words = Words([t.encode() if t else b"" for t in table["text"].to_pylist()], lower=True)
        n = table.num_rows
        keys = np.concatenate([words.hashes, np.repeat(END_WORD, n)])
        text = np.concatenate([np.repeat(np.arange(n), words.counts), np.arange(n)])
        return table, keys, text, ~np.array(table["held_out"].to_pylist(), bool)

    def send(table: pa.Table) -> pa.Table:
        _, keys, text, teaches = word_keys(table)
        unique, inverse = np.unique(keys, return_inverse=True)
        return blobs.packed_rows(table["src"][0].as_py(), unique, n_keys, np.bincount(inverse, teaches[text], len(unique)).astype(np.int64))

    def answer(table: pa.Table) -> pa.Table:
        sources, sizes, (keys, counts) = blobs.gathered(table, "u8", "i8")
        unique, inverse = np.unique(keys, return_inverse=True)
        # numpy sums weights in doubles, exact up to 2 ** 53
        total = np.bincount(inverse, counts, len(unique)).astype(np.int64)
        kb = table["kb"][0].as_py()
        out = blobs.answer_table(kb, sources, total[inverse], sizes)
        known = np.array([(total > 0).sum()], np.int64).tobytes()
        return pa.concat_tables([out, pa.table({"kb": pa.array([-1 - kb], pa.int32()), "src": pa.array(sources[:1], pa.int32()), "body": pa.array([known], pa.binary())})])

    def read(table: pa.Table, said: pa.Table) -> pa.Table:
        columns = {c: [] for c in ("doc_id", "h", "held_out", "n_tokens", "n_known", "logs", "words")}
        if table.num_rows:
            table, keys, text, _ = word_keys(table)
            unique, inverse = np.unique(keys, return_inverse=True)
            asked = pa.array(said["kb"].to_numpy() >= 0, pa.bool_())
            counts = blobs.answers(said.filter(asked), unique, n_keys, "i8")[inverse]
            n = table.num_rows
            # the key buckets' numbers of training words, each told to one document bucket, stand with its first row
            known = np.zeros(n, np.int64)
            known[0] = sum(int(np.frombuffer(b, np.int64)[0]) for k, b in zip(said["kb"].to_pylist(), said["body"].to_pylist()) if k < 0)
            columns = {"words": known, "doc_id": table["doc_id"], "h": table["h"], "held_out": table["held_out"], "n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, counts > 0, n).astype(np.int64), "logs": np.bincount(text, np.log10(counts + 0.5), n)}
        types = {"words": pa.int64(), "doc_id": pa.int64(), "h": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64()}
        return pa.table({c: columns[c] if isinstance(columns[c], pa.ChunkedArray) else pa.array(columns[c], types[c]) for c in ("doc_id", "h", "held_out", "n_tokens", "n_known", "logs", "words")})

    said = docs.groupBy("src").applyInArrow(send, blobs.PACKED).groupBy("kb").applyInArrow(answer, blobs.PACKED)
    scored = saved(docs.groupBy("src").cogroup(said.groupBy("src")).applyInArrow(read, "doc_id long, h long, held_out boolean, n_tokens long, n_known long, logs double, words long"))
    totals = scored.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("known_words"))
    norm = F.log10(F.col("train_tokens") + 0.5 * (F.col("known_words") + 1))
    return scored.crossJoin(F.broadcast(totals)).select("doc_id", "h", "n_tokens", "n_known", "train_tokens", (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"))  # totals: one row


PARTS = "part int, body binary"


def added(parts: DataFrame, add: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The sum of each part's bodies, in two steps, so that a group holds few tasks' bodies."""
    first = parts.withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    return first.groupBy("part", "fan").applyInArrow(add, PARTS).groupBy("part").applyInArrow(add, PARTS)


def lm_scores(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids for every row.

    docs: doc_id, text; other columns are ignored. All documents are scored; those that are
    not held out teach. A null or empty text is its end alone. A null doc_id is scored and
    teaches. Equal rows have equal scores. An empty table gives no rows. Scores are base-10
    logarithms; the model's also covers an end id.
    """
    ship(docs.sparkSession)
    n_docs, n_keys = blobs.buckets_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factorloom.llm.subwords import shared

        subwords = shared(tokenizer)
        end = np.uint16(subwords.tokenizer.get_vocab_size() - 1)
        for batch in small_batches(batches):
            held = [pack_ids(np.append(ids, end)) for ids in subwords.each([t or "" for t in batch["text"].to_pylist()])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "h": batch["h"], "held_out": batch["held_out"], "ids": pa.array(held, pa.binary())})

    encoded = saved(rows.mapInArrow(encode, "doc_id long, h long, held_out boolean, ids binary"))
    teaching = encoded.where("not held_out")

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(IDS, np.int64)
        for batch in small_batches(batches, 500_000, "ids"):
            counts += np.bincount(batch_ids(batch)[0], minlength=IDS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": found, "n": counts[found]})

    counts = np.zeros(IDS)
    for r in teaching.select("ids").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary's size at most
        counts[r["id"]] = r["n"]
    classes = Classes(counts)

    def count_following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = np.zeros((CONTEXTS + 1) * IDS, np.int64)
        for batch in small_batches(batches, 500_000, "ids"):
            ids, _, starts = batch_ids(batch)
            keys, n = np.unique(classes.contexts(ids, starts).astype(np.int64) * IDS + ids, return_counts=True)
            following[keys] += n
        for part in range(CONTEXTS + 1):
            n = following[part * IDS : (part + 1) * IDS]
            found = np.flatnonzero(n)
            if len(found):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "body": pa.array([np.column_stack([found, n[found]]).tobytes()], pa.binary())})

    def add_counts(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, np.int64) for b in table["body"].to_pylist()]).reshape(-1, 2)
        body = np.column_stack(summed(rows[:, 0], rows[:, 1:]))
        return pa.table({"part": table["part"].slice(0, 1), "body": pa.array([body.tobytes()], pa.binary())})

    following = np.zeros((CONTEXTS + 1, IDS))
    for r in added(teaching.select("ids").mapInArrow(count_following, PARTS), add_counts).collect():  # a number for each context and id at most
        found = np.frombuffer(r["body"], np.int64).reshape(-1, 2)
        following[r["part"], found[:, 0]] = found[:, 1]
    follow, inside = classes.odds(following)
    del following

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(follow, None, classes.of)
        teach(model, batches)
        rows, weight = model.learnt()
        body = np.column_stack([rows, weight, model.rows[rows] * weight[:, None]])
        for part in np.split(body, np.flatnonzero(np.diff(rows // ROWS)) + 1):
            if len(part):
                yield pa.RecordBatch.from_pydict({"part": pa.array([int(part[0, 0]) // ROWS], pa.int32()), "body": pa.array([part.astype(np.float64).tobytes()], pa.binary())})

    def add_weights(table: pa.Table) -> pa.Table:
        body = np.concatenate([np.frombuffer(b, np.float64) for b in table["body"].to_pylist()]).reshape(-1, 2 + WIDTH)
        sums = np.column_stack(summed(body[:, 0].astype(np.int64), body[:, 1:]))
        return pa.table({"part": table["part"].slice(0, 1), "body": pa.array([sums.tobytes()], pa.binary())})

    weights = Attention(follow, None, classes.of).rows
    few = teaching.select("h", "ids").coalesce(max(1, math.ceil(counts.sum() / TRAIN_IDS)))  # small partitions learn together, not each a little
    for r in added(few.mapInArrow(learn, PARTS), add_weights).collect():  # the model's weights, a row for each id at most
        sums = np.frombuffer(r["body"], np.float64).reshape(-1, 2 + WIDTH)
        weights[sums[:, 0].astype(np.int64)] = sums[:, 2:] / sums[:, 1:2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(follow, weights, classes.of)
        for batch in batches:
            out, lengths = [], []
            for small in small_batches([batch], 500_000, "ids"):
                ids, sizes, starts = batch_ids(small)
                out.append(score_texts(model, classes, inside, ids, sizes, starts))
                lengths.append(sizes)
            if out:
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "h": batch["h"], "held_out": batch["held_out"], "score": np.concatenate(out), "n_ids": np.concatenate(lengths)})

    base = base_scores(rows, n_docs, n_keys)
    scored = encoded.mapInArrow(score, "doc_id long, h long, held_out boolean, score double, n_ids long")
    once = base.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score")))
    return scored.join(once, scored["doc_id"].eqNullSafe(F.col("_id")) & (scored["h"] == F.col("_h"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_ids")


def score_texts(model: Attention, classes: Classes, inside: np.ndarray, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The base-10 logarithm of each text's odds."""
    windows, text, real = windows_of(ids, sizes, starts, model.before)
    sums = np.zeros(len(windows))
    for a in range(0, len(windows), SCORE_BATCH):
        s = slice(a, a + SCORE_BATCH)
        sums[s] = (model.score(windows[s]) * real[s]).sum(axis=1)
    total = np.bincount(text, sums, len(sizes)) + np.add.reduceat(inside[classes.contexts(ids, starts), ids].astype(np.float64), starts)
    return total / math.log(10)
