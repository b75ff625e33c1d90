"""The trie of conversations' shared beginnings, and what storing each beginning once saves.

A node is the sequence of a conversation's first turns. Its key is the exclusive-or of one
128-bit digest for each (place, role, text), so a running window gives the keys of all
nodes of a conversation, and a node's parent is the key without its own last digest: edges
need no join. Totals over subtrees follow by pointer jumping: in round k every node adds
what stands at its ancestor 2**k levels up, so a trie of depth d takes log2(d) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.components import saved
from factorloom.shipping import ship

#: turns of a conversation that one task puts in order; longer ones are put together from blocks
BLOCK = 1024
#: conversation ids in one row of a node's list
LISTED = 4096
_KEY = ["k1", "k2"]


def _running(rows: DataFrame, by: str, order: Column, block: Column, sums: dict[str, Column], fold) -> DataFrame:
    """Adds running ``fold`` figures over the rows of each ``by`` in order, which may be any number: blocks are folded apart, then what stands before each block is added.

    ``block`` does not descend along ``order``.
    """
    rows = rows.withColumn("_block", block)
    inside = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, "_block").agg(*[fold(c).alias(f"_{name}") for name, c in sums.items()])
    totals = totals.select(F.col(by).alias("_by"), F.col("_block").alias("_of"), *[F.coalesce(fold(F.col(f"_{name}")).over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    rows = rows.select("*", *[fold(c).over(inside).alias(name) for name, c in sums.items()])
    return rows.join(totals, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_of"))).drop("_block", "_of", "_by")


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), d1, d2 (a digest of role and text), words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "d1"), (16, "d2"))]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), *halves, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = F.struct(F.col("turn").isNotNull(), "turn", "role", "d1", "d2")
    ranked = _running(saved(rows), "conv_id", order, F.floor(F.col("turn") / BLOCK), {"pos": F.lit(1)}, F.sum)
    return ranked.select("conv_id", (F.col("pos") + F.col("_pos")).cast("long").alias("pos"), "d1", "d2", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of every rebuilt conversation, and a row without a place (pos 0) for each conversation.

    turns: conv_id, pos, d1, d2, words. A conversation's first h turns are replaced by the
    first h of conversation c - c % 20 (fewer, if it has fewer); h is crc32(c) % 4.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = saved(turns.where("pos <= 3").select(F.col("conv_id").alias("base"), "pos", "d1", "d2", "words"))
    convs = turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", base)
    taken = convs.join(heads, "base").where("pos <= h")  # at most 3 rows of one base, and 20 conversations (39 of base 0)
    lent = convs.join(heads.groupBy("base").agg(F.count("*").alias("held")), "base", "left").select(F.col("conv_id").alias("_c"), "h", F.least("h", F.coalesce("held", F.lit(0))).alias("lent"))
    own = turns.join(lent, F.col("conv_id") == F.col("_c")).where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("lent"))
    roots = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(0).alias("d1"), F.lit(0).alias("d2"), F.lit(0).alias("words"))
    columns = ["conv_id", *[F.col(c).cast("long").alias(c) for c in ("pos", "d1", "d2", "words")]]
    return roots.select(*columns).unionByName(taken.select(*columns)).unionByName(own.select(*columns))


def beginnings(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (key), p1, p2 (the parent's), words, last: one row for each beginning of each conversation."""
    root = F.col("pos") == 0
    x1 = F.when(root, F.lit(0)).otherwise(F.xxhash64("d1", "d2", "pos"))
    x2 = F.when(root, F.lit(0)).otherwise(F.xxhash64("pos", "d2", "d1", F.lit(1)))
    rows = turns.withColumn("x1", x1.cast("long")).withColumn("x2", x2.cast("long"))
    folded = _running(rows, "conv_id", F.col("pos"), F.floor(F.col("pos") / BLOCK), {"k1": F.col("x1"), "k2": F.col("x2")}, F.bit_xor)
    length = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.max("pos").alias("length"))
    keyed = folded.select("conv_id", F.col("pos").alias("depth"), F.col("k1").bitwiseXOR(F.col("_k1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("_k2")).alias("k2"), "x1", "x2", "words")
    keyed = keyed.join(length, F.col("conv_id") == F.col("_c"))
    return keyed.select("conv_id", "depth", *_KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", (F.col("depth") == F.col("length")).alias("last"))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """k1, k2 and, added up over each node's subtree, leaves and saved.

    nodes: k1, k2, p1, p2, depth, leaves, saved. In round k a node's figures hold its
    descendants less than 2**k levels below, and (j1, j2) is its ancestor 2**k levels up;
    nodes without one have ended. The root takes the sum of all nodes instead of jumps.
    Ancestors with many descendants are one side of a join whose skew Spark splits.
    """
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    state = saved(nodes.where("depth > 0").select(*_KEY, "depth", F.col("p1").alias("j1"), F.col("p2").alias("j2"), "leaves", "saved"))
    whole = nodes.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("leaves IS NOT NULL")
    whole = whole.select(*[F.lit(0).cast("long").alias(k) for k in _KEY], "leaves", "saved")  # the root's key is that of no turns
    step = 1
    while step < deepest:
        gains = state.where(F.col("depth") > step).groupBy("j1", "j2").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        grown = state.join(gains.withColumnsRenamed({"j1": "k1", "j2": "k2"}), _KEY, "left")
        grown = grown.select(*_KEY, "depth", "j1", "j2", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        ends = F.col("depth") <= 2 * step
        above = state.where(F.col("depth") > step).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        jumping = grown.where(~ends).join(above, ["j1", "j2"]).select(*_KEY, "depth", F.col("n1").alias("j1"), F.col("n2").alias("j2"), "leaves", "saved")
        state = saved(grown.where(ends).unionByName(jumping))
        step *= 2
    return whole.unionByName(state.select(*whole.columns))


def listed(ends: DataFrame) -> DataFrame:
    """k1, k2, sha: SHA-256 of the ascending, comma-joined conv_ids that end at each node.

    ends: conv_id, k1, k2. A node may end any number of conversations, so ids are put in
    order by a distributed sort over (node, id) and packed into rows of ``LISTED``; only
    those meet by node, in order, and are hashed as they stream by.
    """
    schema = "k1 long, k2 long, first long, ids string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, conv = (batch[c].to_numpy() for c in ("k1", "k2", "conv_id"))
            new = [0, *(i for i in range(1, len(conv)) if k1[i] != k1[i - 1] or k2[i] != k2[i - 1])] if len(conv) else []
            rows = [(a, min(a + LISTED, b)) for x, b in zip(new, [*new[1:], len(conv)]) for a in range(x, b, LISTED)]
            firsts = [a for a, _ in rows]
            yield pa.RecordBatch.from_pydict({"k1": k1[firsts], "k2": k2[firsts], "first": conv[firsts], "ids": pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in rows], pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for k1, k2, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) == key:
                    sha.update(b"," + ids.encode())
                else:
                    out += [(*key, sha.hexdigest())] if key else []
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield _digests(out)
        if key:
            yield _digests([(*key, sha.hexdigest())])

    sorted_ids = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    packed = sorted_ids.mapInArrow(pack, schema)
    return packed.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "k1 long, k2 long, sha string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "sha"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with its members, children and subtree.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are ordered
    by number, null first; equal numbers by role, then by a digest of the text, so repeated
    rows are turns of their own. A null role or text is empty; a row without a conv_id is
    in no conversation. Very long texts count by their digest and number of words. A
    conversation may have any number of turns. An empty table gives no rows, not even a
    root, which would have no members.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. Two digests of 64 bits stand for a sequence.
    """
    ship(conversations.sparkSession)
    rows = saved(beginnings(saved(rebuilt(saved(turns_in_order(conversations))))))
    nodes = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = saved(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    valued = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(F.lit(0)))
    totals = rolled_up(valued)
    ends = listed(rows.where("last"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.where("depth > 0").join(parents, ["p1", "p2"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    full = named.join(totals, _KEY).join(ends, _KEY, "left")
    return full.select(
        *[F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")],
        F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE ordered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (  -- bit by bit over the decimal digits
    SELECT DISTINCT conv_id, 0 AS i, 4294967295::BIGINT AS v FROM ordered
    UNION ALL
    SELECT conv_id, i + 1,
           CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
    FROM (SELECT conv_id, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1))::BIGINT) ELSE v END AS x
          FROM crc WHERE i < 8 * length(conv_id::VARCHAR))
), convs AS (
    SELECT conv_id, xor(v, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = 8 * length(conv_id::VARCHAR)
), parts AS (
    SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h
), paths AS (
    SELECT c.conv_id, coalesce(p.path, []) AS path
    FROM convs c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS path FROM parts GROUP BY conv_id) p USING (conv_id)
), beginnings AS (
    SELECT conv_id, d AS depth, path[1:d] AS node, d = len(path) AS is_last
    FROM paths, unnest(range(0, len(path) + 1)) AS u(d)
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CASE WHEN is_last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
           CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS own
    FROM beginnings GROUP BY node, depth
), children AS (
    SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node
), totals AS (
    SELECT path AS node, sum(leaf) AS n_leaves, sum(own) AS saved_tokens
    FROM (SELECT m.node[1:d] AS path, (m.n_children = 0)::INT AS leaf, m.own AS own FROM counted m, unnest(range(0, m.depth + 1)) AS u(d))
    GROUP BY path
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN totals t ON t.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""
