"""Best-two-fit packing of documents' ids into sequences of a fixed size.

A bin is filled greedily with the longest piece that fits; then its smallest piece is
replaced by two unpacked pieces if those fill the widened gap more tightly. The rule
looks at lengths only, and there are at most as many lengths as a sequence has places,
so the driver plans on the histogram of lengths - a bounded table whatever the corpus -
and repeats each composition while its lengths last. Spark numbers the pieces of each
length and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm import blobs
from factorloom.llm.components import saved
from factorloom.llm.text_arrays import small_batches
from factorloom.shipping import ship

#: distinct chunks of texts that a worker keeps, also while other stages of a pipeline run in it
CHUNKS = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_pair(counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two lengths left with the greatest sum up to ``gap``, the longest first piece among equals."""
    lengths = np.flatnonzero(counts[: gap + 1])
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, gap - lengths, "right") - 1
    other = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    single = (other == lengths) & (counts[lengths] < 2)
    before = np.where(at > 0, lengths[np.maximum(at - 1, 0)], 0)
    other = np.where(single, before, other)
    total = np.where(other > 0, lengths + other, 0)
    if not total.max():
        return None
    k = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(max(lengths[k], other[k])), int(min(lengths[k], other[k]))


def plan_bins(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Compositions (lengths in order) and how many bins have each. counts: pieces by length."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    while left.any():
        bin_, gap = [], size
        while gap:
            fit = np.flatnonzero(left[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            # as many of the longest as fit, as taking one after the other would
            times = min(int(left[length]), gap // length)
            bin_ += [length] * times
            left[length] -= times
            gap -= length * times
        if gap and bin_:
            smallest = bin_[-1]
            pair = best_pair(left, gap + smallest)
            if pair and sum(pair) > smallest:
                bin_[-1:] = pair
                left[smallest] += 1
                for length in pair:
                    left[length] -= 1
        used = np.bincount(bin_, minlength=len(left))
        lengths = np.flatnonzero(used)
        again = int((left[lengths] // used[lengths]).min())
        left -= again * used
        out.append((bin_, 1 + again))
    return out


def plan_table(plan: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, ...]:
    """For each length, in order of number: first number, pieces of it in a bin, first bin, offset of the first of them. Returned with each length's first row."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(size + 1)]
    numbered = np.zeros(size + 1, np.int64)
    bins = 0
    for lengths, times in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            k = lengths.count(length)
            rows[length].append((int(numbered[length]), k, bins, offset))
            numbered[length] += k * times
            offset += length * k
        bins += times
    at = np.append(0, np.cumsum([len(r) for r in rows]))
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 4)
    return at, *flat.T


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``size`` ids.

    docs: doc_id, text; other columns are ignored. A document is its text's ids and then
    ``end_id``; a null text counts as empty and has that id alone. Documents over ``size``
    are cut into pieces of ``size``, the first of them taking what is over. A null doc_id
    stays null; rows that share a doc_id are packed each for itself. An empty table gives
    no rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids
    with ``keep_ids``.
    """
    spark = docs.sparkSession
    ship(spark)
    _, buckets = blobs.buckets_for(docs)
    schema = _PIECES + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factorloom.llm.subwords import shared

        subwords = shared(tokenizer, CHUNKS)
        for batch in small_batches(batches):
            ids, at = subwords.encode([t or "" for t in batch["text"].to_pylist()])
            rows: list[tuple] = []
            for d, a, b in zip(batch["doc_id"].to_pylist(), at, at[1:]):
                own = np.append(ids[a:b], end_id).astype("<u4")
                first = len(own) % size or size
                cuts = [0, *range(first, len(own) + 1, size)]
                rows += [(d, p, x, y - x, zlib.crc32(own[x:y]), own[x:y]) for p, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    pieces = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema).withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counted = pieces.groupBy("length", "b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    counted = saved(counted.withColumn("before", F.coalesce(before, F.lit(0))))
    counts = np.zeros(size + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    at, number, each, bins, offsets = plan_table(plan_bins(counts, size), size)

    rank = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32", "start"))
    numbered = pieces.withColumn("rank", rank).join(counted.drop("n"), ["length", "b"]).withColumn("number", F.col("before") + F.col("rank") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(len(at)) * (1 << 40)
        keys = np.repeat(base[: len(at) - 1], np.diff(at)) + number
        for batch in batches:
            length, n = batch["length"].to_numpy(), batch["number"].to_numpy()
            row = np.searchsorted(keys, base[length] + n, "right") - 1
            k = n - number[row]
            columns = {c.split()[0]: batch[c.split()[0]] for c in schema.split(", ")}
            columns |= {"sequence_id": pa.array(bins[row] + k // each[row], pa.int64()), "offset": pa.array(offsets[row] + k % each[row] * length, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return numbered.select(*[c.split()[0] for c in schema.split(", ")], "number").mapInArrow(place, schema + ", sequence_id long, offset long")
