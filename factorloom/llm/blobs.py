"""Exchange of packed arrays between document buckets and key buckets.

Corpus-wide questions about short keys (does this window, shingle or word occur
elsewhere?) would take one shuffled row for each key. Here a document bucket packs
its keys into one binary row per key bucket, the key bucket answers in the same
order, and only the answers travel back. Both sides are plain
``groupBy().applyInArrow`` steps: Spark shuffles, retries and spills them as any
other rows, and a lost executor only repeats deterministic steps.

A bucket's records are sent once each: callers leave out what they can tell from their
own bucket alone, so copies that a bucket holds many times are asked about once. Numbers of
buckets follow from the bytes of all texts. Where key buckets outnumber a document bucket's
keys, a packed row holds one key, as in a plain shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: text bytes for a document bucket and a key bucket
DOC_BUCKET_BYTES = 1_500_000
KEY_BUCKET_BYTES = 10_000_000

PLANES = "planes"
PACKED = "kb int, src int, body binary"


def buckets_for(docs: DataFrame) -> tuple[int, int]:
    """Numbers of document and key buckets; both grow with the texts' bytes, however well their files are compressed. docs: text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(48, math.ceil(size / DOC_BUCKET_BYTES)), max(64, math.ceil(size / KEY_BUCKET_BYTES))


def bucket_of(n: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def row_bucket(n: int) -> Column:
    """A bucket by doc_id and text, so rows without an id, or of one id, are many buckets' and equal rows one's."""
    return bucket_of(n, F.col("doc_id"), F.col("text"))


def key_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def deal(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings keys of a bucket together (and keeps their order), the buckets that occur and where each begins (and the end)."""
    bucket = key_bucket(keys, n).astype(np.uint16 if n <= 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, found.astype(np.int64), np.append(first, len(keys))


def pack(*arrays: np.ndarray) -> bytes:
    """Little-endian arrays of one length, one after the other, after that length."""
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def planes(ascending: np.ndarray) -> np.ndarray:
    """Steps of 64-bit numbers that mostly ascend, all lowest bytes first: Spark's compression leaves little of the high ones."""
    steps = np.diff(ascending.astype(np.int64), prepend=np.int64(0))
    return steps.view(np.uint8).reshape(-1, 8).T


def pack_planes(*columns: np.ndarray) -> bytes:
    """Whole numbers of one length that mostly ascend, as ``planes``."""
    return np.int64(len(columns[0])).tobytes() + b"".join(planes(c).tobytes() for c in columns)


def unpack(body: bytes, *types: str) -> list[np.ndarray]:
    """Arrays of numpy's types, or of ``planes``."""
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for t in types:
        if t == PLANES:
            steps = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()
            out.append(np.cumsum(steps))
        else:
            out.append(np.frombuffer(body, t, n, at))
        at += out[-1].nbytes
    return out


def packed_rows(src: int, keys: np.ndarray, n: int, *columns: np.ndarray, ascending: np.ndarray | None = None) -> pa.Table:
    """One row for each key bucket: the keys and columns that go there, and the ``ascending`` column as planes at the end."""
    order, found, at = deal(keys, n)
    keys, columns = keys[order], [c[order] for c in columns]
    last = [] if ascending is None else [ascending[order]]
    bodies = [pack(keys[a:b], *(c[a:b] for c in columns), *(planes(c[a:b]) for c in last)) for a, b in zip(at, at[1:])]
    return pa.table({"kb": pa.array(found, pa.int32()), "src": pa.array(np.full(len(found), src), pa.int32()), "body": pa.array(bodies, pa.binary())})


def answers(tables: pa.Table, keys: np.ndarray, n: int, dtype: str) -> np.ndarray:
    """What the key buckets said of each key, in the order of ``keys``."""
    order, found, at = deal(keys, n)
    got = dict(zip(tables["kb"].to_pylist(), tables["body"].to_pylist()))
    said = np.zeros(len(keys), dtype)
    for k, a, b in zip(found.tolist(), at, at[1:]):
        said[order[a:b]] = np.frombuffer(got[k], dtype)
    return said


def answer_table(kb: int, sources: list[int], values: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Rows that go back: for each source its share of ``values``."""
    at = np.append(0, np.cumsum(sizes))
    return pa.table({"kb": pa.array([kb] * len(sources), pa.int32()), "src": pa.array(sources, pa.int32()), "body": pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})


def gathered(table: pa.Table, *types: str) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Sources in ascending order, how many records each sent, and the records' columns."""
    rows = sorted(zip(table["src"].to_pylist(), table["body"].to_pylist()))
    parts = [unpack(body, *types) for _, body in rows]
    return [s for s, _ in rows], np.array([len(p[0]) for p in parts], np.int64), [np.concatenate(c) for c in zip(*parts)]


def sorted_docs(table: pa.Table, id_col: str = "doc_id") -> tuple[list[int | None], list[bytes]]:
    """A bucket's documents by id (null last), then text; null text is empty."""
    ids = table[id_col].to_pylist()
    texts = [x.encode() if x else b"" for x in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def id_order(ids: list[int | None]) -> np.ndarray:
    """Ids as numbers to compare by; null is above all."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
