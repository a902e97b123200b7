"""Trailing robust baselines and robust scores within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def trailing_robust_z(df: DataFrame, part: list[str], order: str, value: str, window: int = 12, least: int = 6) -> DataFrame:
    """Add baseline, scale and z of each row against its trailing window (the row itself excluded).

    baseline: median of the last ``window`` values, null under ``least`` of them. scale: 1.4826
    times the median of the lagged absolute residuals, each against its own baseline; where
    that is not above 0 or not known, the trailing sample deviation; 0 is null.
    """
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(-window, -1)
    out = df.withColumn("_n", F.count(value).over(w)).withColumn("baseline", F.when(F.col("_n") >= least, F.percentile(value, F.lit(0.5)).over(w)))
    out = out.withColumn("_r", F.abs(F.col(value) - F.col("baseline")))
    out = out.withColumn("_mad", F.when(F.count("_r").over(w) >= least, F.percentile("_r", F.lit(0.5)).over(w) * MAD_SCALE))
    out = out.withColumn("_sd", F.when(F.col("_n") >= least, F.stddev_samp(value).over(w)))
    out = out.withColumn("scale", F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.nullif("_sd", F.lit(0.0))))
    return out.withColumn("z", (F.col(value) - F.col("baseline")) / F.col("scale")).drop("_n", "_r", "_mad", "_sd")


def group_robust_z(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """Add the group's median, the ratio to it and the robust z (MAD, else sample deviation; null if both are 0)."""
    w = Window.partitionBy(*part)
    out = df.withColumn("median", F.median(value).over(w))
    out = out.withColumn("_mad", F.median(F.abs(F.col(value) - F.col("median"))).over(w)).withColumn("_sd", F.stddev_samp(value).over(w))
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_SCALE).otherwise(F.nullif("_sd", F.lit(0.0)))
    out = out.withColumn("robust_z", (F.col(value) - F.col("median")) / scale)
    return out.withColumn("ratio_to_median", F.try_divide(F.col(value), F.col("median"))).drop("_mad", "_sd")


def time_index(df: DataFrame, part: list[str], order: str, since: str) -> DataFrame:
    """Add t (0, 1, ...), post (0/1 from ``since`` on) and t_post (periods since the first post one)."""
    w = Window.partitionBy(*part).orderBy(order)
    out = df.withColumn("t", F.row_number().over(w) - 1).withColumn("post", (F.col(order) >= F.lit(since).cast("date")).cast("int"))
    return out.withColumn("t_post", F.greatest(F.sum("post").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1, F.lit(0)))


def quantile_buckets(df: DataFrame, value: str, k: int = 6) -> DataFrame:
    """Add ``bucket``: how many of the k-1 breaks (the sorted values at floor(i n / k)) are at or below the value; null stays null.

    Positions are found by rank over the distinct values with their counts, so equal values share a bucket.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    breaks = [F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * i / k), F.col(value))) for i in range(1, k)]
    breaks = ranked.agg(F.array(*breaks).alias("_breaks"))
    bucket = F.size(F.filter("_breaks", lambda b: b <= F.col(value)))
    return df.join(F.broadcast(breaks)).withColumn("bucket", F.when(F.col(value).isNotNull(), bucket)).drop("_breaks")


def histogram(df: DataFrame, value: str, bins: int = 26, stretch: float = 1.05) -> DataFrame:
    """(bin, low, high, n) of equal bins over [0, stretch * max]; the last bin holds its right end; empty bins have n 0."""
    top = df.agg((F.max(value) * stretch).alias("top"))
    rows = df.where(F.col(value) >= 0).join(F.broadcast(top)).withColumn("bin", F.least(F.floor(F.col(value) * bins / F.col("top")), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(top))
    out = every.join(F.broadcast(counts), "bin", "left")
    return out.select("bin", (F.col("bin") * F.col("top") / bins).alias("low"), ((F.col("bin") + 1) * F.col("top") / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
