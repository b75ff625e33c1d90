"""News as a stream: each story once, and daily sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorloom.functions.scalar import content_hash


def distinct_stories(stream: DataFrame, time: str = "published_at", late: str = "2 days") -> DataFrame:
    """Articles whose (isin, text) is new within the watermark; state is dropped behind it."""
    keyed = stream.withColumn("content_hash", content_hash(F.col("text"))).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["isin", "content_hash"])


def sentiment_windows(stream: DataFrame, time: str = "published_at", late: str = "2 days", length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """window, isin, n, mean score over sliding windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), "isin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def decayed_sentiment(stream: DataFrame, time: str = "published_at", late: str = "2 days", length: str = "30 days", slide: str = "1 day", half_life: float = 7.0) -> DataFrame:
    """window, isin, n, score over sliding windows: the mean score, halved in weight every ``half_life`` days before the window's end."""
    windowed = stream.withWatermark(time, late).withColumn("window", F.window(time, length, slide))
    seconds = F.expr(f"timestampdiff(SECOND, cast({time} AS timestamp_ntz), cast(window.end AS timestamp_ntz))")
    weight = F.pow(F.lit(0.5), seconds / 86400 / half_life)
    return windowed.groupBy("window", "isin").agg(F.count("*").alias("n"), (F.sum(F.col("score") * weight) / F.sum(weight)).alias("score"))


def month_counts(stream: DataFrame, time: str = "published_at", late: str = "2 days") -> DataFrame:
    """month, isin, n: tumbling counts of calendar months."""
    return stream.withWatermark(time, late).groupBy(F.trunc(F.to_date(time), "month").alias("month"), "isin").agg(F.count("*").alias("n"))


def into_store(stream: DataFrame, path: str, checkpoint: str, keys: list[str], day: str | None = None) -> StreamingQuery:
    """Append rows that the store at ``path`` lacks; a batch that is repeated after a failure adds nothing.

    Several streams may feed one store one after the other: what a batch wrote is known by
    its query (which keeps its id as long as its checkpoint) and its number. With ``day``,
    a column among the keys, only the stored rows of the batch's days are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        fresh = batch.dropDuplicates(keys)
        try:
            stored = spark.read.parquet(path).where((F.col("batch") != number) | (F.col("run") != run)).select(*keys)
            if day:
                first, last = batch.agg(F.min(day), F.max(day)).first()  # pushed down to the files' statistics
                stored = stored.where(F.col(day).between(first, last)) if first is not None else stored.limit(0)
            fresh = fresh.join(stored, keys, "left_anti")
        except Exception as missing:  # the store begins with its first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        marked = fresh.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
