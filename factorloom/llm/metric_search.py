"""Exact top-k inner products by a paged M-tree over the angle between vectors.

The angle is a metric, so what a tree node stores bounds every product below it: for a
query at angle t from a node's routing vector, no vector within the covering radius r is at
an angle less than t - r, and none longer than the node's longest has a product above
|q| |v| cos(t - r). The tree has three levels under its root:

* routing vectors (a bounded sample) share out all vectors among nodes;
* a node's vectors are dealt into *pages* of bounded size, each with a routing vector of
  its own, a covering radius and its shortest and longest length;
* a page has *leaves* around pivots. A leaf stores its pivot's angle to the page's routing
  vector, an entry its angle to the pivot: these parent distances rule leaves and entries
  out before any product with them is worked out.

A query starts with the best of the page that it lies in itself. What it has found is a
threshold: it goes on to those nodes, pages and leaves alone whose bound reaches it, best
first. Products of entries are whole numbers, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.components import saved
from factorloom.llm.text_arrays import ranges
from factorloom.shipping import ship

#: vectors in a page (about), and in a leaf; routing vectors that the driver draws at most
PAGE, LEAF, ROUTES = 2048, 48, 1024
#: queries that one task holds beside a page (about)
QUERIES = 20_000
#: added to angles and bounds, so that rounding of doubles never rules out what belongs to the result
SLACK = 1e-6
_INDEXED = "vec binary, node long, rows array<struct<vec_id:long,uid:long>>, queried boolean"
_STRUCT = pa.struct([("score", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64())])
_FOUND = "vec binary, score long, vec_id long, uid long"


def whole_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, uid, vec (floor(256 x) of each component as bytes of 64-bit numbers) of the vectors that take part."""
    for batch in batches:
        lists = batch["embedding"]
        values = np.floor(256 * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))  # null becomes NaN
        sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
        at = np.append(0, np.cumsum(sizes))
        ids = batch["vec_id"].to_pylist()
        keep, vecs = [], []
        for i, (a, b) in enumerate(zip(at, at[1:])):
            x = values[a:b]
            # a product of longer vectors might not be a 64-bit number
            if ids[i] is not None and b > a and np.isfinite(x).all() and float(x @ x) < 2.0**62:
                keep.append(i)
                vecs.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"].take(pa.array(keep, pa.int64())), "vec": pa.array(vecs, pa.binary())})


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The angle between each row of x and of y (doubles); a zero vector is at a right angle to all."""
    a, b = (np.sqrt((z * z).sum(axis=1)) for z in (x, y))
    return np.arccos(np.clip((x @ y.T) / np.maximum(a[:, None] * b, 1e-300), -1, 1))


def bounds(length: np.ndarray, angle: np.ndarray, radius: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """No product is above these with vectors within ``radius`` of what stands at ``angle``, of such lengths. A zero vector's angles mean nothing; with it, the shortest is 0 and its own product, 0, is below any bound of a node with it."""
    c = np.cos(np.clip(angle - radius - SLACK, 0, math.pi))
    return length * np.where(c >= 0, longest, shortest) * c * np.where(c >= 0, 1 + SLACK, 1 - SLACK) + SLACK


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i8").reshape(len(vecs), -1)


class Best:
    """The k best (score, vec_id, uid) of each of n queries so far; -1 as uid: none yet."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.vec_id, self.uid = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        #: a score that at least k rows elsewhere reach
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor

    def threshold(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, at: np.ndarray, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        """Rows found for queries ``at`` (columns: candidates)."""
        score, vec_id, uid = (np.concatenate([a[at], b], axis=1) for a, b in ((self.score, score), (self.vec_id, vec_id), (self.uid, uid)))
        k = self.score.shape[1]
        # lexsort's last key counts most; ~score descends without leaving 64 bits
        order = np.lexsort((uid, vec_id, ~score), axis=1)[:, :k]
        self.score[at], self.vec_id[at], self.uid[at] = (np.take_along_axis(x, order, 1) for x in (score, vec_id, uid))


class Page:
    """Vectors of one page with their leaves, as arrays."""

    def __init__(self, vecs: np.ndarray, rows: list[list[dict]]):
        self.dim = vecs.shape[1]
        x = vecs.astype(float)
        middle = np.argmax(x @ x.mean(axis=0)) if len(x) else 0
        self.center = vecs[middle]
        n_leaves = max(1, math.ceil(len(x) / LEAF))
        # pivots: far from each other, one after the other
        pivots, far = [int(middle)], angles(x, x[[middle]])[:, 0]
        for _ in range(n_leaves - 1):
            pivots.append(int(np.argmax(far)))
            far = np.minimum(far, angles(x, x[[pivots[-1]]])[:, 0])
        to_pivot = angles(x, x[pivots])
        leaf = np.argmin(to_pivot, axis=1)
        order = np.argsort(leaf, kind="stable")
        self.vecs, leaf = vecs[order], leaf[order]
        self.entry_angle = to_pivot[order, leaf]
        self.length = np.sqrt((x * x).sum(axis=1))[order]
        self.pivots = vecs[pivots]
        self.pivot_angle = angles(x[pivots], x[[middle]])[:, 0]
        self.edges = np.searchsorted(leaf, np.arange(n_leaves + 1))
        self.leaf_radius = np.array([self.entry_angle[a:b].max(initial=0) for a, b in zip(self.edges, self.edges[1:])])
        self.leaf_shortest = np.array([self.length[a:b].min(initial=np.inf) if b > a else 0 for a, b in zip(self.edges, self.edges[1:])])
        self.leaf_longest = np.array([self.length[a:b].max(initial=0) for a, b in zip(self.edges, self.edges[1:])])
        self.radius = float(angles(x, x[[middle]]).max(initial=0))
        held = [rows[i] for i in order]
        self.row_start = np.append(0, np.cumsum([len(r) for r in held]))
        self.vec_id = np.array([r["vec_id"] for own in held for r in own], np.int64)
        self.uid = np.array([r["uid"] for own in held for r in own], np.int64)

    _ARRAYS = ("center", "vecs", "entry_angle", "length", "pivots", "pivot_angle", "edges", "leaf_radius", "leaf_shortest", "leaf_longest", "row_start", "vec_id", "uid")

    def to_bytes(self) -> bytes:
        from io import BytesIO

        out = BytesIO()
        np.savez(out, radius=self.radius, **{c: getattr(self, c) for c in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> Page:
        from io import BytesIO

        page = cls.__new__(cls)
        with np.load(BytesIO(body)) as found:
            for c in cls._ARRAYS:
                setattr(page, c, found[c])
            page.radius = float(found["radius"])
        return page

    def search(self, queries: np.ndarray, best: Best) -> int:
        """Adds this page's rows to the best of each query; returns how many products with entries were worked out."""
        q, v = queries.astype(float), self.vecs.astype(float)
        length, worked = np.sqrt((q * q).sum(axis=1)), 0
        if length.max(initial=0) * self.length.max(initial=0) >= 2.0**52:
            q, v = queries, self.vecs  # doubles might be rounded
        to_center = angles(queries.astype(float), self.center[None].astype(float))[:, 0]
        alive = np.flatnonzero(bounds(length, to_center, self.radius, self.leaf_shortest.min(), self.leaf_longest.max()) >= best.threshold())
        if not len(alive):
            return 0
        # by parent distances: a pivot stands at |query's angle - pivot's angle| or more
        least = np.abs(to_center[alive, None] - self.pivot_angle)
        near = bounds(length[alive, None], least, self.leaf_radius, self.leaf_shortest, self.leaf_longest) >= best.threshold()[alive, None]
        some = near.any(axis=0)
        angle = np.full(near.shape, np.nan)
        angle[:, some] = angles(queries[alive].astype(float), self.pivots[some].astype(float))
        reach = np.where(near, bounds(length[alive, None], angle, self.leaf_radius, self.leaf_shortest, self.leaf_longest), -np.inf)
        order = np.argsort(-reach, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            rows = np.arange(len(alive))
            open_ = reach[rows, leaf] >= best.threshold()[alive]
            if not open_.any():
                break
            for k in np.unique(leaf[open_]):
                a, b = self.edges[k], self.edges[k + 1]
                who = np.flatnonzero(open_ & (leaf == k))
                at = alive[who]
                # an entry is at least |query's angle to the pivot - entry's angle to the pivot| away
                away = np.abs(angle[who, k, None] - self.entry_angle[a:b])
                wanted = bounds(length[at, None], away, 0.0, self.length[a:b], self.length[a:b]) >= best.threshold()[at, None]
                columns = np.flatnonzero(wanted.any(axis=0))
                if not len(columns):
                    continue
                found = (q[at] @ v[a + columns].T).astype(np.int64)
                worked += found.size
                copies = self.row_start[a + columns + 1] - self.row_start[a + columns]
                own = ranges(self.row_start[a + columns], copies)
                shape = (len(at), len(own))
                best.add(at, np.repeat(found, copies, axis=1), np.broadcast_to(self.vec_id[own], shape), np.broadcast_to(self.uid[own], shape))
        return worked


def _found(vecs: list[bytes], best: Best) -> pa.Table:
    """Rows of what was found; only those that reach the query's floor."""
    i, j = np.nonzero((best.uid >= 0) & (best.score >= best.floor[:, None]))
    return pa.table({"vec": pa.array([vecs[x] for x in i], pa.binary()), "score": best.score[i, j], "vec_id": best.vec_id[i, j], "uid": best.uid[i, j]})


def top_products(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query row with the other rows.

    embeddings: vec_id, embedding (array of numbers); other columns are ignored. Queries
    are rows whose vec_id is divisible by ``every``. A component x counts as floor(256 x).
    Ties go to the smaller vec_id. Vectors that are null or empty, or hold null or
    non-finite components, take no part; nor do rows without a vec_id, nor vectors whose
    whole numbers' squares add up to 2**62 or more, whose products might exceed 64 bits.
    Vectors of different lengths do not meet. Repeated rows are rows each: a row is no
    candidate of itself, but of its copies. An empty table gives no rows.

    Equal vectors are searched once: their k + 1 smallest ids stand for them, so a vector
    that many rows share is one entry of the tree and one query. The driver draws at most
    ``ROUTES`` routing vectors of each of at most 16 lengths (other lengths have a node
    each) and what bounds their nodes; all rows are indexed. A task holds one page and
    about ``QUERIES`` queries; pages are sent only where a query's bound reaches them.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = saved(embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(whole_vectors, "vec_id long, vec binary").withColumn("uid", F.monotonically_increasing_id()))
    asks = F.col("vec_id") % every == 0
    # Spark cuts groups of rank <= k + 1 before it sends them, so a hot vector is few rows of each task
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id", "uid"))).where(F.col("rn") <= k + 1)
    held = first.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("rows"))  # at most k + 1 each
    asked = rows.where(asks).select("vec").distinct().withColumn("queried", F.lit(True))
    distinct = saved(held.join(asked, "vec", "left").withColumn("queried", F.coalesce("queried", F.lit(False))))

    # the root: a bounded sample of routing vectors of the commonest lengths
    dim = F.octet_length("vec")
    lengths = distinct.groupBy(dim.alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()
    routes: dict[int, np.ndarray] = {}
    for dim_, n in lengths:
        few = distinct.where(dim == dim_).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(ROUTES, math.ceil(n / PAGE))).collect()
        routes[dim_] = _matrix([bytes(r.vec) for r in few])
    starts = dict(zip(routes, np.cumsum([0, *map(len, routes.values())]).tolist()))
    sent = spark.sparkContext.broadcast(routes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = sent.value
        for batch in batches:
            vecs = batch["vec"].to_pylist()
            node = np.array([-len(v) for v in vecs], np.int64)  # a length without routing vectors
            angle, size = np.full(len(vecs), math.pi), np.zeros(len(vecs))
            for d in {len(v) for v in vecs}:
                own = np.flatnonzero(node == -d)
                x = _matrix([vecs[i] for i in own]).astype(float)
                size[own] = np.sqrt((x * x).sum(axis=1))
                if d in routes:
                    to = angles(x, routes[d].astype(float))
                    near = np.argmin(to, axis=1)
                    angle[own], node[own] = to[np.arange(len(own)), near], starts[d] + near
            yield pa.RecordBatch.from_pydict({"vec": batch["vec"], "node": pa.array(node), "rows": batch["rows"], "queried": batch["queried"], "angle": pa.array(angle), "size": pa.array(size)})

    placed = saved(distinct.mapInArrow(place, _INDEXED + ", angle double, size double"))
    nodes = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("size").alias("shortest"), F.max("size").alias("longest"))
    nodes = saved(nodes.withColumn("pages", F.ceil(F.col("n") / PAGE).cast("int")))
    groups = max(1, math.ceil(placed.where("queried").count() / QUERIES))
    paged = placed.join(nodes.select("node", "pages"), "node").withColumn("page", F.pmod(F.xxhash64("vec"), F.col("pages")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        vecs = table["vec"].to_pylist()
        order = sorted(range(len(vecs)), key=vecs.__getitem__)
        rows_, queried = table["rows"].to_pylist(), table["queried"].to_numpy()
        page = Page(_matrix([vecs[i] for i in order]), [rows_[i] for i in order])
        own = [i for i in order if queried[i]]
        q = _matrix([vecs[i] for i in own]) if own else np.zeros((0, page.dim), np.int64)
        best = Best(len(own), k + 1)
        page.search(q, best)
        found = _found([vecs[i] for i in own], best)
        out = pa.table({"vec": pa.array([vecs[i] for i in own], pa.binary()), "floor": best.score[:, -1]})
        n = 1 + len(own)
        return pa.table(
            {
                "node": pa.array([table["node"][0].as_py()] * n, pa.int64()),
                "page": pa.array([table["page"][0].as_py()] * n, pa.int32()),
                "body": pa.array([page.to_bytes(), *[None] * len(own)], pa.binary()),
                "vec": pa.array([None, *out["vec"].to_pylist()], pa.binary()),
                "floor": pa.array([None, *out["floor"].to_pylist()], pa.int64()),
                "found": pa.array([None, *_lists(found, out["vec"].to_pylist())], pa.list_(_STRUCT)),
            }
        )

    index = saved(paged.groupBy("node", "page").applyInArrow(build, "node long, page int, body binary, vec binary, floor long, found array<struct<score:long,vec_id:long,uid:long>>"))
    queries = index.where("vec IS NOT NULL")
    directory = [r.asDict() for r in nodes.where("node >= 0").collect()]  # at most 16 * ROUTES rows

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = sent.value
        by_dim = {d: [r for r in directory if starts[d] <= r["node"] < starts[d] + len(routes[d])] for d in routes}
        for batch in batches:
            home_node, home_page = batch["node"].to_numpy(), batch["page"].to_numpy()
            vecs, floors = batch["vec"].to_pylist(), batch["floor"].to_numpy()
            out: list[tuple] = []
            for d in {len(v) for v in vecs}:
                own = np.array([i for i, v in enumerate(vecs) if len(v) == d])
                if d not in by_dim:
                    continue  # such a query's only other pages are those of its own node: below
                x = _matrix([vecs[i] for i in own]).astype(float)
                length, found = np.sqrt((x * x).sum(axis=1)), by_dim[d]
                to = angles(x, routes[d][[r["node"] - starts[d] for r in found]].astype(float))
                reach = bounds(length[:, None], to, *(np.array([r[c] for r in found]) for c in ("radius", "shortest", "longest")))
                for i, j in np.argwhere(reach >= floors[own][:, None]):
                    out.append((found[j]["node"], found[j]["pages"], own[i]))
            for i, v in enumerate(vecs):
                if len(v) not in by_dim:
                    out.append((-len(v), None, i))
            who = [x[2] for x in out]
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array([x[0] for x in out], pa.int64()),
                    "home_node": pa.array(home_node[who], pa.int64()),
                    "home_page": pa.array(home_page[who], pa.int32()),
                    "vec": pa.array([vecs[i] for i in who], pa.binary()),
                    "floor": pa.array(floors[who], pa.int64()),
                }
            )

    going = queries.select("node", "page", "vec", "floor").mapInArrow(visits, "node long, home_node long, home_page int, vec binary, floor long")
    going = going.join(nodes.select("node", "pages"), "node").withColumn("page", F.explode(F.expr("sequence(0, pages - 1)"))).where("node <> home_node OR page <> home_page")
    going = saved(going.withColumn("g", F.pmod(F.xxhash64("home_node", "home_page"), F.lit(groups)).cast("int")).select("node", "page", "g", "vec", "floor"))
    needed = going.select(F.col("node").alias("n_"), F.col("page").alias("p_"), F.col("g").alias("g_")).distinct()
    pages = index.where("body IS NOT NULL").join(needed, (F.col("node") == F.col("n_")) & (F.col("page") == F.col("p_"))).select("n_", "p_", "g_", "body")

    def search(page: pa.Table, asking: pa.Table) -> pa.Table:
        vecs = asking["vec"].to_pylist()
        if not vecs or not page.num_rows:
            return _found([], Best(0, k + 1))
        order = sorted(range(len(vecs)), key=vecs.__getitem__)
        best = Best(len(vecs), k + 1, asking["floor"].to_numpy()[order])
        vecs = [vecs[i] for i in order]
        Page.from_bytes(page["body"][0].as_py()).search(_matrix(vecs), best)
        return _found(vecs, best)

    elsewhere = pages.groupBy("n_", "p_", "g_").cogroup(going.groupBy("node", "page", "g")).applyInArrow(search, _FOUND)
    at_home = queries.select("vec", F.explode("found").alias("f")).select("vec", "f.*")
    ranked = Window.partitionBy("vec").orderBy(F.desc("score"), "vec_id", "uid")
    best = at_home.unionByName(elsewhere).withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") <= k + 1)
    answers = best.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("rn", "score", "vec_id", "uid"))).alias("found"))  # at most k + 1 each

    # a query row is not its own candidate; what is left are its k best
    asking = rows.where(asks).select(F.col("vec_id").alias("query_id"), F.col("uid").alias("query_uid"), "vec")
    met = asking.join(answers, "vec").withColumn("found", F.slice(F.filter("found", lambda f: f["uid"] != F.col("query_uid")), 1, k))
    return met.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def _lists(found: pa.Table, vecs: list[bytes]) -> list[list[dict]]:
    """The found rows of each vector, in the order of ``vecs``."""
    by_vec: dict[bytes, list[dict]] = {v: [] for v in vecs}
    for r in found.to_pylist():
        by_vec[r.pop("vec")].append(r)
    return [by_vec[v] for v in vecs]


ORACLE_SQL = """
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
           row_number() OVER (PARTITION BY q.uid ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id, c.uid) AS rank
    FROM whole q JOIN whole c ON len(q.v) = len(c.v) AND q.uid <> c.uid WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM scored WHERE rank <= 5
"""
