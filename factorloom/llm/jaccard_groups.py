"""Exact set-similarity join of documents by a token-group matrix.

A document is the set of its word shingles; two link when their Jaccard similarity
reaches a threshold. Every step below keeps all linked pairs:

1. equal sets are joined first, so copies cost one set.
2. a shingle that no other set holds can't be shared: a set with more of them than the
   threshold leaves room for has no partner and leaves. A third of the shingles tells of
   most sets; the rest are judged by all of theirs, among themselves, again while many leave.
3. the rest are partitioned into *families*. A set's shingles are ordered by how many sets
   hold them, rarest first; linked sets share one of the first, of which there is one more
   than a partner may lack. Such a shared one joins families. Passages that many documents
   quote stand last, so they chain no families together.
4. inside a family, similar sets stand together in groups. A matrix holds each group's
   shingle union; a query opens a group only if its overlap with the union reaches what
   a link needs, and only opened groups are compared member by member.

A family larger than a block is compared block by block: first within blocks (of similar
sets) and with some leaders. Only sets that share a key with a set of another component
are left then; they form smaller families, in which all but the largest component go round
the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm import blobs
from factorloom.llm.components import connected_components, fresh, saved
from factorloom.llm.embedding_dedup import least_labels
from factorloom.llm.text_arrays import Rolling, Words, mix, ranges, small_batches
from factorloom.shipping import ship

_U = np.uint64
#: sets in a block of a family, leaders that every block of it sees, members of a group, queries compared with a group at a time
BLOCK, LEADERS, GROUP, OPENED = 2048, 64, 16, 256
#: one shingle in SAMPLE is looked up to find sets with too many shingles of their own; sets under SMALL look up all
SAMPLE, SMALL = 3, 96
#: least numbers of sets of the levels by which shingles are ordered: each number to 64, then eight levels an octave, so that a byte tells them
LEVELS = np.unique(np.append(np.arange(1, 65), 64 * 2 ** (np.arange(1, 191) / 8)).astype(np.int64))


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets' hashes, ascending, one set after the other, and their offsets.

    Words are lower-cased (A-Z). A text of fewer words than ``size`` has its whole
    sequence as its only shingle, one without words none.
    """
    words = Words(texts, lower=True)
    rolling = Rolling(words.hashes)
    counts = words.counts
    starts = ranges(words.offsets[:-1], np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)))
    doc = np.repeat(np.arange(len(texts)), np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)))
    ends = np.minimum(starts + size, words.offsets[1:][doc])
    keys = rolling.slices(starts, ends) if len(starts) else np.zeros(0, _U)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    keep = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])) if len(keys) else np.zeros(0, bool)
    keys, doc = keys[keep], doc[keep]
    return keys, np.searchsorted(doc, np.arange(len(texts) + 1))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that any partner of a set of n needs."""
    return -(-n * percent // 100)


def rarest(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set such that linked sets share one: its first shingles by level and hash, without those that no other set holds."""
    n = len(tokens)
    first = np.lexsort((tokens, levels))[: n - int(needed(np.int64(n), percent)) + 1]
    return tokens[first[levels[first] > 1]]


def linked_pairs(sets: list[np.ndarray], queries: np.ndarray, members: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked (query, member) pairs, as indices of ``sets``, through the token-group matrix."""
    sizes = np.array([len(s) for s in sets], np.int64)
    members = members[np.lexsort([[int(sets[m][k]) if len(sets[m]) > k else 0 for m in members] for k in (1, 0)])]  # sets of equal least shingles stand together
    groups = [members[a : a + GROUP] for a in range(0, len(members), GROUP)]
    unions = [np.unique(np.concatenate([sets[m] for m in g])) for g in groups]
    q_tokens = np.concatenate([sets[q] for q in queries])
    q_of = np.repeat(np.arange(len(queries)), sizes[queries])
    q_sizes = sizes[queries]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for group, union in zip(groups, unions):
        at = np.minimum(np.searchsorted(union, q_tokens), len(union) - 1)
        hit = np.flatnonzero(union[at] == q_tokens)
        bound = np.bincount(q_of[hit], minlength=len(queries))
        least = np.maximum(needed(q_sizes, percent), 1)
        opened = np.flatnonzero((bound >= least) & (sizes[group].max() * 100 >= q_sizes * percent) & (sizes[group].min() * percent <= q_sizes * 100))
        if not len(opened):
            continue
        held = np.zeros((len(group), len(union)), np.float32)
        for k, m in enumerate(group):
            held[k, np.searchsorted(union, sets[m])] = 1
        row = np.full(len(queries), -1)
        row[opened] = np.arange(len(opened))
        hit = hit[row[q_of[hit]] >= 0]
        of = row[q_of[hit]]  # ascending
        for first in range(0, len(opened), OPENED):
            some = opened[first : first + OPENED]
            s = slice(*np.searchsorted(of, (first, first + OPENED)))
            wide = np.zeros((len(some), len(union)), np.float32)
            wide[of[s] - first, at[hit[s]]] = 1
            overlap = np.rint(wide @ held.T).astype(np.int64)
            total = q_sizes[some][:, None] + sizes[group][None, :] - overlap
            i, j = np.nonzero(overlap * 100 >= percent * total)
            found.append((queries[some[i]], group[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(c) for c in zip(*found))
    apart = i != j
    return i[apart], j[apart]


def shingle_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: each document's set size and the smallest doc_id that links lead to.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no shingles
    and link with nothing. Rows that share a doc_id are one node: their links count
    together. A row with a null doc_id gets no links and a null component. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    n_docs, n_keys = blobs.buckets_for(docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tokens, at = shingle_sets([t.encode() if t else b"" for t in batch["text"].to_pylist()], size)
            sums = [np.append(_U(0), np.cumsum(mix(tokens + _U(k)))) for k in (1, 2)]
            marks = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_shingles": pa.array(np.diff(at), pa.int64()), "s1": marks[0], "s2": marks[1]})

    signed = saved(docs.mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long"))
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))

    # 2. sets with too many shingles of their own leave
    bucketed = docs.where("doc_id is not null").select("doc_id", "text", blobs.bucket_of(n_docs, F.col("doc_id")).alias("src"))
    chosen = reps.select("rep", "n_shingles", blobs.bucket_of(n_docs, F.col("rep")).alias("src"))

    def rep_sets(table: pa.Table, chosen: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The representatives' ids, shingles and offsets. A repeated doc_id may bring sets beside the chosen one; they stay as sets of that node."""
        wanted = set(zip(chosen["rep"].to_pylist(), chosen["n_shingles"].to_pylist()))
        ids, texts = blobs.sorted_docs(table)
        tokens, at = shingle_sets(texts, size)
        keep, seen = [], set()
        for i, d in enumerate(ids):
            held = tokens[at[i] : at[i + 1]].tobytes() if (d, int(at[i + 1] - at[i])) in wanted else b""
            if held and (d, held) not in seen:
                seen.add((d, held))
                keep.append(i)
        keep = np.array(keep, np.int64)
        sizes = np.diff(at)[keep]
        return [ids[i] for i in keep], tokens[ranges(at[:-1][keep], sizes)], np.append(0, np.cumsum(sizes)).astype(np.int64)

    def looked_up(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        small = np.repeat(np.diff(at) < SMALL, np.diff(at))
        return np.flatnonzero(small | (mix(tokens) % _U(SAMPLE) == 0))

    def send_tokens(table: pa.Table, chosen: pa.Table) -> pa.Table:
        if not table.num_rows or not chosen.num_rows:
            return blobs.packed_rows(0, np.zeros(0, _U), n_keys)
        _, tokens, at = rep_sets(table, chosen)
        return blobs.packed_rows(table["src"][0].as_py(), tokens[looked_up(tokens, at)], n_keys)

    def answer_tokens(table: pa.Table) -> pa.Table:
        sources, sizes, (tokens,) = blobs.gathered(table, "u8")
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        return blobs.answer_table(table["kb"][0].as_py(), sources, np.searchsorted(LEVELS, counts, "right")[inverse].astype(np.uint8), sizes)

    def survivors(table: pa.Table, said: pa.Table) -> pa.Table:
        steps = np.array(said["kb"].to_pylist())
        chosen = said.filter(pa.array(steps == -1))
        out: dict[str, list] = {"doc_id": [], "tokens": []}
        if table.num_rows and chosen.num_rows:
            ids, tokens, at = rep_sets(table, chosen)
            asked = looked_up(tokens, at)
            own = np.zeros(len(tokens), np.int64)
            own[asked] = blobs.answers(said.filter(pa.array(steps >= 0)), tokens[asked], n_keys, "u1") == 1
            sizes = np.diff(at)
            # a partner of a small set might not have looked up all of its own
            if len(tokens):
                small = np.repeat(sizes < SMALL * percent // 100, sizes)
                own[~small & (mix(tokens) % _U(SAMPLE) != 0)] = 0
            alone = np.append(0, np.cumsum(own))
            alone = alone[at[1:]] - alone[at[:-1]]
            for i in np.flatnonzero(alone <= sizes - needed(sizes, percent)):
                out["doc_id"].append(ids[i])
                out["tokens"].append(tokens[at[i] : at[i + 1]].tobytes())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary())})

    unique = bucketed.groupBy("src").cogroup(chosen.groupBy("src")).applyInArrow(send_tokens, blobs.PACKED).groupBy("kb").applyInArrow(answer_tokens, blobs.PACKED)
    said = unique.select("kb", "src", "body", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n_shingles")).unionByName(
        chosen.select(F.lit(-1).alias("kb"), "src", F.lit(None).cast("binary").alias("body"), "rep", "n_shingles")
    )
    sets = saved(bucketed.groupBy("src").cogroup(said.groupBy("src")).applyInArrow(survivors, "doc_id long, tokens binary"))

    def send_all(table: pa.Table) -> pa.Table:
        _, tokens, _ = held_sets(table)
        return blobs.packed_rows(table["src"][0].as_py(), tokens, n_keys)

    def held_sets(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """A bucket's sets in order, their shingles and offsets."""
        order = sorted(range(table.num_rows), key=lambda i: (table["doc_id"][i].as_py(), table["tokens"][i].as_py()))
        table = table.take(order)
        parts = [np.frombuffer(t, _U) for t in table["tokens"].to_pylist()]
        return table, np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)

    def prune(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(["doc_id", "tokens"]).append_column("rare", pa.array([], pa.binary()))
        table, tokens, at = held_sets(table)
        levels = blobs.answers(said, tokens, n_keys, "u1")
        own = np.append(0, np.cumsum(levels == 1))
        sizes = np.diff(at)
        stay = np.flatnonzero(own[at[1:]] - own[at[:-1]] <= sizes - needed(sizes, percent))
        keys = [rarest(tokens[at[i] : at[i + 1]], levels[at[i] : at[i + 1]], percent).tobytes() for i in stay]
        return table.select(["doc_id", "tokens"]).take(pa.array(stay)).append_column("rare", pa.array(keys, pa.binary()))

    # now by all shingles, among the sets that are left, until few more leave
    left = sets.count()
    if not left:
        sets = sets.withColumn("rare", F.lit(b""))
    while left:
        placed = sets.select("doc_id", "tokens", blobs.bucket_of(n_docs, F.col("doc_id")).alias("src"))
        alone = placed.groupBy("src").applyInArrow(send_all, blobs.PACKED).groupBy("kb").applyInArrow(answer_tokens, blobs.PACKED)
        sets = saved(placed.groupBy("src").cogroup(alone.groupBy("src")).applyInArrow(prune, "doc_id long, tokens binary, rare binary"))
        before, left = left, sets.count()
        if left > 0.9 * before:
            break

    # 3. families
    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(t, _U) for t in batch["rare"].to_pylist()]
            if keys:
                counts = [len(k) for k in keys]
                ids, own = (np.repeat(np.array(batch[c].to_pylist(), np.int64), counts) for c in ("doc_id", "component"))
                yield from blobs.packed_rows(0, np.concatenate(keys), n_keys, ids, own).to_batches()

    def join_keys(table: pa.Table) -> pa.Table:
        """The sets of each key point at its least; keys within one component join nothing."""
        _, _, (keys, ids, own) = blobs.gathered(table, "u8", "i8", "i8")
        order = np.lexsort((ids, keys))
        keys, ids, own = keys[order], ids[order], own[order]
        new = np.append(True, keys[1:] != keys[:-1])
        key = np.cumsum(new) - 1
        least, first = ids[new][key], own[new][key]
        mixed = np.zeros(int(new.sum()), bool)
        mixed[key[own != first]] = True
        pairs = np.unique(np.stack([ids, least])[:, mixed[key] & (ids != least)], axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    def families_of(rows: DataFrame) -> DataFrame:
        """doc_id, family, blocks, block. rows: doc_id, rare, component. Sets of one least shingle share a block, unless they are too many for one."""
        joined = rows.select("doc_id", "rare", "component").mapInArrow(send_keys, blobs.PACKED).groupBy("kb").applyInArrow(join_keys, "a long, b long")
        family = connected_components(joined).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "family")
        least = sets.groupBy("doc_id").agg(F.min(F.substring("tokens", 1, 8)).alias("least"))
        sizes = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = family.join(sizes, "family").join(least, "doc_id").withColumn("cell", F.pmod(F.xxhash64("least"), F.col("blocks")))
        cells = placed.groupBy("family", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("subs"))
        sub = F.pmod(F.xxhash64("doc_id"), F.col("subs"))
        return saved(placed.join(cells, ["family", "cell"]).select("doc_id", "family", "blocks", (F.col("cell") * (1 << 24) + sub).alias("block")))

    placed = families_of(sets.withColumn("component", F.col("doc_id")))

    # 4. links inside families
    tasks = max(64, n_docs)

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("family", "part", "block", "doc_id", "member", "query")), range(table.num_rows)))
        blob = table["tokens"]
        out: list[tuple[int, int]] = []
        start = 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end][:3] == rows[start][:3]:
                continue
            group = rows[start:end]
            start = end
            if len(group) < 2:
                continue
            sets = [np.frombuffer(blob[r[6]].as_py(), _U) for r in group]
            i, j = linked_pairs(sets, np.flatnonzero([r[5] for r in group]), np.flatnonzero([r[4] for r in group]), percent)
            label = least_labels(len(group), i, j)
            out += [(group[k][3], group[label[k]][3]) for k in np.flatnonzero(label != np.arange(len(group)))]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    def links(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("task", F.pmod(F.xxhash64("family", "part", "block"), F.lit(tasks)).cast("int"))
        return dealt.join(sets.select("doc_id", "tokens"), "doc_id").groupBy("task").applyInArrow(compare, "a long, b long")

    def all_blocks(rows: DataFrame) -> DataFrame:
        return rows.select("family", F.col("block").alias("to")).distinct()

    member = lambda m, q, part=F.lit(0): (F.col("block"), part.cast("int").alias("part"), F.lit(m).alias("member"), F.lit(q).alias("query"))
    # a family of one block is settled by its task: what it sends are its components
    found = saved(links(placed.where("blocks = 1").select("doc_id", "family", *member(True, True))).select(F.col("a").alias("node"), F.col("b").alias("component")))
    large = placed.where("blocks > 1")
    if large.limit(1).count():
        rank = F.row_number().over(Window.partitionBy("family", "block").orderBy("doc_id"))
        leaders = large.withColumn("rank", rank).where(F.col("rank") * F.col("blocks") <= LEADERS + F.col("blocks"))
        visiting = leaders.join(all_blocks(large), "family").where("to <> block").select("doc_id", "family", F.col("to").alias("block")).select("doc_id", "family", *member(True, False))
        edges = saved(links(large.select("doc_id", "family", *member(True, True)).unionByName(visiting)).distinct())
        now = connected_components(edges)
        now = saved(large.select("doc_id").join(now.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        # what is left: sets that share a key with another component's
        again = families_of(sets.select("doc_id", "rare").join(now, "doc_id"))
        counts = again.join(now, "doc_id").groupBy("family", "component").agg(F.count("*").alias("rows"))
        main = counts.groupBy("family").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.ceil((F.sum("rows") - F.max("rows")) / BLOCK).alias("parts"))
        rest = saved(again.join(now, "doc_id").join(main, "family").where("component <> main").select("doc_id", "family", (1 + F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts"))).alias("p")))
        asking = rest.join(all_blocks(again), "family").withColumnRenamed("to", "block").select("doc_id", "family", *member(False, True, F.col("p")))
        asked = again.join(rest.select("family", "p").distinct(), "family").select("doc_id", "family", *member(True, False, F.col("p")))
        met = asking.unionByName(asked).groupBy("doc_id", "family", "block", "part").agg(F.max("member").alias("member"), F.max("query").alias("query"))
        # components so far are the nodes of what is left to join
        more = links(met).join(now.select(F.col("doc_id").alias("a"), F.col("component").alias("x")), "a").join(now.select(F.col("doc_id").alias("b"), F.col("component").alias("y")), "b")
        merged = connected_components(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
        ended = now.join(merged.select(F.col("node").alias("component"), F.col("component").alias("end")), "component", "left").select(F.col("doc_id").alias("node"), F.coalesce("end", "component").alias("component"))
        found = found.unionByName(ended)

    same = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = signed.join(same, ["n_shingles", "s1", "s2"], "left")
    # rows of one doc_id are one node
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, with all its columns whatever their names: the one with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together. A row without one
    comes after all others and is told from its like by its text; of equal ones one stays.
    Null and empty texts link with nothing: such rows stay, but for those without a doc_id
    all but one. An empty table gives no rows.
    """
    node = fresh("node", docs.columns)
    late = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    keyed = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), late))
    kept = shingle_components(keyed.select(F.col(node).alias("doc_id"), "text"), size, percent).where("doc_id = component_id").select(F.col("doc_id").alias(node)).distinct()
    stay = keyed.join(kept, node, "left_semi")
    without = stay.where("doc_id is null").dropDuplicates([node])
    return stay.where("doc_id is not null").select(docs.columns).unionByName(without.select(docs.columns))
