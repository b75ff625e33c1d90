"""Distributed connected components: alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names. Only a local session without one, which has one machine's disk, gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder for what executors write and read; a cluster must name it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="factorloom-shared-")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is none of ``taken`` (in any case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


#: Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage
FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Inside, queries that are planned and run to their end free the disk of their shuffles as they end."""
    before = spark.conf.get(FREEING, None)
    spark.conf.set(FREEING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREEING)
        else:
            spark.conf.set(FREEING, before)


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read from there. Their shuffles' files are gone then."""
    ensure_checkpoint_dir(df.sparkSession)
    with freeing(df.sparkSession):
        # a frame keeps the setting it was made with, and the caller's may run again
        return df.select("*").checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the least node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the least of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node points at two others, or at one that points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return bool(seen.agg(F.coalesce(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))), F.lit(False))).first()[0])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node that has an edge.

    edges: a, b (numbers). Loops, repeated and two-way edges and rows with a null count
    once or not at all; an empty table gives no rows. Nothing is collected but whether a
    round has left any node unsettled; each round is checkpointed, so lineage stays short.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while _unsettled(edges):
        edges = saved(_small_star(_large_star(edges)))
    # every edge is now (node, least of its component)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
