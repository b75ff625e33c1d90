"""Cross-sectional statistics. Missing values stay missing; groups are one date's companies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factorloom.shipping import ship

#: how far winsorising reaches, what turns a median deviation into a standard deviation, and the smallest sector with statistics of its own
LIMIT, MAD_SCALE, MIN_SECTOR = 3.0, 1.4826, 5


def _bounded(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull(), None).when(low.isNull(), x).otherwise(F.least(F.greatest(x, low), high))


def winsor_stats(df: DataFrame, value: str, keys: list[str], prefix: str, limit: float = LIMIT) -> DataFrame:
    """Adds {prefix}n, {prefix}low, {prefix}high, {prefix}mean, {prefix}std: of the winsorised values in each group.

    The bounds are median +- limit * 1.4826 * MAD; a MAD of 0 gives way to the standard
    deviation, and a standard deviation of 0 or NULL leaves values as they are.
    """
    w = Window.partitionBy(*keys)
    v = F.col(value)
    df = df.withColumn(f"{prefix}n", F.count(v).over(w)).withColumn(f"{prefix}med", F.median(v).over(w)).withColumn(f"{prefix}sd0", F.stddev_samp(v).over(w))
    df = df.withColumn(f"{prefix}mad", F.median(F.abs(v - F.col(f"{prefix}med"))).over(w))
    scale = F.when(F.col(f"{prefix}mad") > 0, F.col(f"{prefix}mad") * MAD_SCALE).when(F.col(f"{prefix}sd0") > 0, F.col(f"{prefix}sd0"))
    df = df.withColumn(f"{prefix}low", F.col(f"{prefix}med") - limit * scale).withColumn(f"{prefix}high", F.col(f"{prefix}med") + limit * scale)
    clipped = _bounded(v, F.col(f"{prefix}low"), F.col(f"{prefix}high"))
    return df.withColumn(f"{prefix}clipped", clipped).withColumn(f"{prefix}mean", F.avg(f"{prefix}clipped").over(w)).withColumn(f"{prefix}std", F.stddev_samp(f"{prefix}clipped").over(w))


def winsorize(df: DataFrame, value: str, keys: list[str], out: str, limit: float = LIMIT) -> DataFrame:
    stats = winsor_stats(df, value, keys, "_w", limit)
    return stats.select(*df.columns, F.col("_wclipped").alias(out))


def sector_zscore(df: DataFrame, value: str, keys: list[str], sector: str, out: str, min_sector: int = MIN_SECTOR, limit: float = LIMIT) -> DataFrame:
    """z of the value itself by its sector's winsorised mean and deviation; sectors with too few values, and rows without a sector, go by all of the group. No deviation gives 0.

    A group is one date's companies, and its statistics, which are those of ``winsor_stats``,
    are worked out in numpy.
    """
    ship(df.sparkSession)

    def scored(group: pa.Table) -> pa.Table:
        x = group.column(value).cast(pa.float64())
        there = x.is_valid().to_numpy()
        x = x.fill_null(0.0).to_numpy()
        names = pc.dictionary_encode(group.column(sector)).combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        mean, std = (np.full(len(x), s) for s in winsorised(x[there], limit))
        for code in range(len(names.dictionary)):
            own = codes == code
            values = x[own & there]
            if len(values) >= min_sector:
                mean[own], std[own] = winsorised(values, limit)
        apart = _above(std)
        with np.errstate(all="ignore"):
            z = np.where(apart, (x - mean) / np.where(apart, std, 1.0), 0.0)
        return group.append_column(out, pa.array(z, mask=~there | (~apart & (codes < 0))))

    kind = StructType([*df.schema.fields, StructField(out, DoubleType())])
    return df.groupBy(*keys).applyInArrow(scored, kind)


def _above(x):
    """Whether numbers are above 0, as Spark has it: what is not a number is above all."""
    return (x > 0) | np.isnan(x)


def winsorised(values: np.ndarray, limit: float = LIMIT) -> tuple[float, float]:
    """Mean and standard deviation of values after winsorising, as ``winsor_stats`` has them; a deviation that there is not is 0."""
    if len(values) < 2:
        return (values[0] if len(values) else 0.0), 0.0
    with np.errstate(all="ignore"):
        med, sd0 = _median(values), values.std(ddof=1)
        mad = _median(np.abs(values - med))
        scale = mad * MAD_SCALE if _above(mad) else sd0
        if _above(scale):
            values = np.fmin(np.maximum(values, med - limit * scale), med + limit * scale)
        return values.mean(), values.std(ddof=1)


def _median(values: np.ndarray) -> float:
    ordered = np.sort(values)  # what is not a number comes last
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def standardise(value: str, keys: list[str]) -> Column:
    """z over the group; no deviation gives 0 where a value is present."""
    w = Window.partitionBy(*keys)
    std = F.stddev_samp(value).over(w)
    return F.when(std > 0, (F.col(value) - F.avg(value).over(w)) / std).otherwise(F.when(F.col(value).isNotNull(), 0.0))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def quantile_bucket(value: str, keys: list[str], tie: str, buckets: Column) -> Column:
    """Bucket from 0 by interpolated quantile edges, closed on the right; equal values in order of ``tie``."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie))
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.greatest(F.lit(0), F.ceil((r - 1) * buckets / F.when(n > 1, n - 1)) - 1).cast("int")
