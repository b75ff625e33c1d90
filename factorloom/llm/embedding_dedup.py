"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.components import connected_components, saved
from factorloom.shipping import ship

#: rows of a hash bucket that meet in one block; larger buckets are split into pairs of blocks
BLOCK = 1024
_LINKS = "a long, b long, n long"


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table's key and number of tables: buckets keep their size as n grows, and a pair right at the threshold is met with probability ``recall``."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 4)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def valid_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vec (bytes of doubles) of the vectors that can have a cosine, scaled by a power of two to a largest component of about one, so that no square leaves the range of doubles."""
    for batch in batches:
        lists = batch["embedding"]
        flat = lists.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
        sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
        at = np.append(0, np.cumsum(sizes))
        ids = batch["vec_id"].to_pylist()
        keep = []
        for i, (a, b) in enumerate(zip(at, at[1:])):
            x = values[a:b]
            if ids[i] is not None and b > a and np.isfinite(x).all() and x.any():
                keep.append((ids[i], scaled(x).tobytes()))
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array([k[0] for k in keep], pa.int64()), "vec": pa.array([k[1] for k in keep], pa.binary())})


def scaled(x: np.ndarray) -> np.ndarray:
    """The vector times a power of two (in two steps: one alone may be out of range)."""
    shift = -int(np.frexp(np.abs(x).max())[1])
    return np.ldexp(np.ldexp(x, shift // 2), shift - shift // 2) + 0.0  # no negative zeros


def links_in(x: np.ndarray, codes: np.ndarray, table: int, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of x) that collide first in ``table``; within ``left`` if there is no ``right``."""
    other = left if right is None else right
    found = np.argwhere(x[left] @ x[other].T >= threshold)
    if right is None:
        found = found[found[:, 0] < found[:, 1]]
    i, j = left[found[:, 0]], other[found[:, 1]]
    if table:
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            first[s] = ~(codes[i[s], :table] == codes[j[s], :table]).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that links lead to, for each of n rows."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_near_dedup(embeddings: DataFrame, threshold: float = 0.95, recall: float = 0.9999) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    embeddings: vec_id, embedding (array of numbers); other columns are ignored. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Equal vectors are compared once and counted as
    often as they occur. Rows that repeat a vec_id with one vector count as one vector; with
    several, each has its links, and every row of the id tells the most links that one of
    them has and the smallest component. A null vec_id is kept with no links and no
    component. An empty table gives no rows.

    Tables and bits follow from the number of vectors. Buckets over ``BLOCK`` rows are
    split into pairs of blocks, so no task holds more than two blocks of a bucket; a task
    sends back counts and a spanning forest, never all pairs.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = saved(embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(valid_vectors, "vec_id long, vec binary").distinct())
    same = saved(rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = same.count()
    bits, tables = plan_tables(n, threshold, recall)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes = []
            for vec in batch["vec"].to_pylist():
                x = np.frombuffer(vec)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(len(x)).standard_normal((len(x), bits * tables))
                codes.append((x @ planes[len(x)] > 0).reshape(tables, bits) @ weights)
            yield pa.RecordBatch.from_pydict({"rep": batch["rep"], "copies": batch["copies"], "vec": batch["vec"], "codes": pa.array([c.tolist() for c in codes], pa.list_(pa.int64()))})

    coded = same.mapInArrow(encode, "rep long, copies long, vec binary, codes array<long>")
    placed = coded.select("*", F.octet_length("vec").alias("dim"), F.posexplode("codes").alias("t", "code"))
    large = saved(placed.groupBy("dim", "t", "code").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")))
    blocked = placed.join(large, ["dim", "t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = blocked.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "rep", "copies", "vec", "codes", "dim", "t", "code", "mine", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j")
    )
    groups = max(64, math.ceil(n * tables / 20_000))
    met = met.withColumn("task", F.pmod(F.xxhash64("dim", "t", "code", "i", "j"), F.lit(groups)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in ("rep", "copies", "dim", "t", "code", "mine", "i", "j")}
        order = np.lexsort([columns[c] for c in ("rep", "mine", "j", "i", "code", "t", "dim")])
        columns = {c: v[order] for c, v in columns.items()}
        vecs = table["vec"].take(pa.array(order)).to_pylist()
        codes = np.array(table["codes"].combine_chunks().flatten()).reshape(-1, tables)[order]
        keys = np.stack([columns[c] for c in ("dim", "t", "code", "i", "j")])
        edges = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        rep, copies = columns["rep"], columns["copies"]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges, np.append(edges[1:], len(rep))):
            if b - a < 2:
                continue
            x = np.frombuffer(b"".join(vecs[a:b])).reshape(b - a, -1)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            place = np.arange(b - a)
            if columns["i"][a] == columns["j"][a]:
                i, j = links_in(x, codes[a:b], int(columns["t"][a]), place, None, threshold)
            else:
                own = columns["mine"][a:b] == columns["i"][a]
                i, j = links_in(x, codes[a:b], int(columns["t"][a]), place[own], place[~own], threshold)
            if not len(i):
                continue
            i, j = a + i, a + j
            count = np.bincount(i - a, copies[j], b - a) + np.bincount(j - a, copies[i], b - a)
            linked = np.flatnonzero(count)
            out.append((rep[a + linked], np.full(len(linked), -1), count[linked].astype(np.int64)))
            label = least_labels(b - a, i - a, j - a)
            moved = np.flatnonzero(label != place)
            out.append((rep[a + moved], rep[a + label[moved]], np.zeros(len(moved), np.int64)))
        both = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"a": both[0], "b": pa.array(both[1], pa.int64(), mask=both[1] == -1) if len(both[1]) else pa.array([], pa.int64()), "n": both[2]})

    found = saved(met.groupBy("task").applyInArrow(compare, _LINKS).groupBy("a", "b").agg(F.sum("n").alias("n")))
    components = connected_components(found.where("b is not null").select("a", "b"))
    counted = found.where("b is null").select(F.col("a").alias("rep"), F.col("n").alias("others"))
    merged = (
        same.join(counted, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = rows.join(merged, "vec").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = embeddings.select(F.col("vec_id").cast("long"))
    return every.join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    )
