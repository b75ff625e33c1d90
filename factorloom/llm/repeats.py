"""Windows that occur earlier in a corpus: the engine under both exact-repeat operators.

A *cutter* turns a bucket's documents into runs of windows around anchors. An anchor
is chosen from a window's content alone, so equal windows hold equal anchors at equal
offsets. Three packed exchanges follow:

1. anchors: windows whose anchor occurs once leave. A run whose whole content occurred
   earlier is settled. Runs with an anchor that has several contents remain.
2. windows: the remaining runs' windows, by hash; the earliest of each stays.
3. the settled runs and windows go back to their documents, which are cut there.

What an earlier document of the same bucket settles is not asked about, so a bucket sends
one record of a passage, however many copies of it it holds. Rows in 1 follow the number
of anchors (a few hundredths of the units), in 2 the number of *distinct* repeated runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm import blobs
from factorloom.llm.text_arrays import ranges
from factorloom.shipping import ship

UNIQUE, OPEN, SETTLED = 0, 1, 2


@dataclass
class Runs:
    """Runs of windows in order of document and place."""

    first: np.ndarray  # first window's start
    last: np.ndarray  # last window's start
    doc: np.ndarray  # document's index in the bucket
    anchor: np.ndarray  # hash of the anchor
    content: np.ndarray  # hash of all that the run covers and of the anchor's offset in it
    hash_windows: Callable[[np.ndarray], np.ndarray]


def anchor_flags(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, same_doc: bool) -> np.ndarray:
    """UNIQUE, OPEN or SETTLED for each run; runs of one document come in order of place."""
    order = np.lexsort((doc, content, anchor))
    a, c, d = anchor[order], content[order], doc[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    new_content = new_anchor | np.append(True, c[1:] != c[:-1])
    group = np.cumsum(new_content) - 1
    settled = ~new_content if same_doc else d > d[new_content][group]
    several = (np.add.reduceat(new_content, np.flatnonzero(new_anchor)) > 1)[np.cumsum(new_anchor) - 1]
    out = np.empty(len(a), np.uint8)
    out[order] = np.where(settled, SETTLED, np.where(several, OPEN, UNIQUE))
    return out


def later(keys: np.ndarray, doc: np.ndarray, same_doc: bool) -> np.ndarray:
    """1 for each window that has an earlier equal."""
    order = np.lexsort((doc, keys))
    k, d = keys[order], doc[order]
    new = np.append(True, k[1:] != k[:-1])
    out = np.empty(len(k), np.uint8)
    out[order] = ~new if same_doc else d > d[new][np.cumsum(new) - 1]
    return out


def settled_at_home(doc: np.ndarray, same_doc: bool, *keys: np.ndarray) -> np.ndarray:
    """Which records equal one of an earlier document of their own bucket (or an earlier one of their own). Records come in order of document and place; doc: ids to compare by."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort(keys)  # stable: equal records stay in order
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    d = doc[order]
    out = np.empty(len(doc), bool)
    out[order] = ~new if same_doc else d > d[new][np.cumsum(new) - 1]
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same places as fewest intervals; start and end ascend."""
    if not len(start):
        return start.astype(np.int64), end.astype(np.int64)
    apart = np.append(True, start[1:] > np.maximum.accumulate(end)[:-1])
    return start[apart].astype(np.int64), np.maximum.reduceat(end, np.flatnonzero(apart)).astype(np.int64)


_ROWS = "kb int, src int, kind int, body binary"
_ASKED, _CARRIED = 0, 1


def with_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.add_column(2, "kind", pa.array(np.full(table.num_rows, kind), pa.int32()))


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table["kind"].to_numpy() == kind, pa.bool_()))


def cut_repeats(docs: DataFrame, cutter: Callable[[list[bytes]], Runs], finish: Callable[[list, list[bytes], np.ndarray, np.ndarray], pa.Table], schema: str, size: int, same_doc: bool) -> DataFrame:
    """``finish(ids, texts, starts, ends)`` of the repeated intervals, for each bucket of documents.

    docs: doc_id, text. ``size``: units in a window. ``same_doc``: an earlier start in the
    same document counts too. What a bucket knows after the second step (its settled runs,
    its open windows in the order in which it asked) travels with its questions, so the
    last step need not cut the texts into runs again.
    """
    ship(docs.sparkSession)
    n_docs, n_keys = blobs.buckets_for(docs)
    docs = docs.select("doc_id", "text", blobs.row_bucket(n_docs).alias("src"))

    def send_anchors(table: pa.Table) -> pa.Table:
        ids, texts = blobs.sorted_docs(table)
        runs = cutter(texts)
        doc = blobs.id_order(ids)[runs.doc]
        ask = ~settled_at_home(doc, same_doc, runs.content, runs.anchor)
        return blobs.packed_rows(table["src"][0].as_py(), runs.anchor[ask], n_keys, runs.content[ask], ascending=doc[ask])

    def answer_anchors(table: pa.Table) -> pa.Table:
        sources, sizes, (anchor, content, doc) = blobs.gathered(table, "u8", "u8", blobs.PLANES)
        return blobs.answer_table(table["kb"][0].as_py(), sources, anchor_flags(anchor, content, doc, same_doc), sizes)

    def send_windows(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return with_kind(blobs.packed_rows(0, np.zeros(0, np.uint64), n_keys), _ASKED)
        src = table["src"][0].as_py()
        ids, texts = blobs.sorted_docs(table)
        runs = cutter(texts)
        number = blobs.id_order(ids)
        home = settled_at_home(number[runs.doc], same_doc, runs.content, runs.anchor)
        flags = np.full(len(home), SETTLED, np.uint8)
        flags[~home] = blobs.answers(said, runs.anchor[~home], n_keys, "u1")
        settled, live = np.flatnonzero(flags == SETTLED), np.flatnonzero(flags == OPEN)
        counts = runs.last[live] - runs.first[live] + 1
        starts, doc = ranges(runs.first[live], counts), number[np.repeat(runs.doc[live], counts)]
        keys = runs.hash_windows(starts)
        home = settled_at_home(doc, same_doc, keys)
        opens, ends = np.append(runs.first[settled], starts[home]), np.append(runs.last[settled], starts[home]) + size
        by_place = np.lexsort((ends, opens))
        starts, doc, keys = starts[~home], doc[~home], keys[~home]
        asked = blobs.packed_rows(src, keys, n_keys, ascending=doc)
        order, found, at = blobs.deal(keys, n_keys)
        known = blobs.pack_planes(*merged(opens[by_place], ends[by_place])), blobs.pack_planes(starts[order]), blobs.pack(found, at[:-1])
        body = np.array([len(k) for k in known], np.int64).tobytes() + b"".join(known)
        carried = pa.table({"kb": pa.array([src % n_keys], pa.int32()), "src": pa.array([src], pa.int32()), "body": pa.array([body], pa.binary())})
        return pa.concat_tables([with_kind(asked, _ASKED), with_kind(carried, _CARRIED)])

    def answer_windows(table: pa.Table) -> pa.Table:
        carried, asked = of_kind(table, _CARRIED).select(["kb", "src", "kind", "body"]), of_kind(table, _ASKED)
        if not asked.num_rows:
            return carried
        sources, sizes, (keys, doc) = blobs.gathered(asked, "u8", blobs.PLANES)
        return pa.concat_tables([with_kind(blobs.answer_table(asked["kb"][0].as_py(), sources, later(keys, doc, same_doc), sizes), _ASKED), carried])

    def cut(table: pa.Table, said: pa.Table) -> pa.Table:
        ids, texts = blobs.sorted_docs(table)
        body = of_kind(said, _CARRIED)["body"][0].as_py()
        edges = np.append(24, 24 + np.cumsum(np.frombuffer(body, np.int64, 3)))
        runs, windows, dealt = (body[a:b] for a, b in zip(edges, edges[1:]))
        opens, ends = blobs.unpack(runs, blobs.PLANES, blobs.PLANES)
        (starts,) = blobs.unpack(windows, blobs.PLANES)
        found, at = blobs.unpack(dealt, "i8", "i8")
        answers = of_kind(said, _ASKED)
        got = dict(zip(answers["kb"].to_pylist(), answers["body"].to_pylist()))
        repeated = np.zeros(len(starts), np.uint8)
        for kb, a, b in zip(found.tolist(), at, np.append(at[1:], len(starts))):
            repeated[a:b] = np.frombuffer(got[kb], np.uint8)
        starts = starts[repeated == 1]
        return finish(ids, texts, np.concatenate([opens, starts]), np.concatenate([ends, starts + size]))

    flags = docs.groupBy("src").applyInArrow(send_anchors, blobs.PACKED).groupBy("kb").applyInArrow(answer_anchors, blobs.PACKED)
    windows = docs.groupBy("src").cogroup(flags.groupBy("src")).applyInArrow(send_windows, _ROWS)
    said = windows.groupBy("kb").applyInArrow(answer_windows, _ROWS)
    return docs.groupBy("src").cogroup(said.groupBy("src")).applyInArrow(cut, schema)
