"""What the fact table holds: totals, windows of labels, narrative coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.series import cases, narratives


def span() -> list:
    """Count, first and last date."""
    return [F.count(F.lit(1)).alias("n"), F.min("date_received").alias("first_date"), F.max("date_received").alias("last_date")]


def coverage(c: DataFrame) -> DataFrame:
    return c.agg(*span(), narratives(), F.count_distinct("company").alias("companies"), F.count_distinct("state").alias("states"))


def segment_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("segment").agg(*span()).orderBy(F.desc("n"), "segment")


def label_windows(c: DataFrame) -> DataFrame:
    return c.groupBy("product", "segment").agg(*span()).orderBy("segment", "first_date", "product")


def narrative_coverage(c: DataFrame, since: str = "2015-01") -> DataFrame:
    months = c.where(F.col("month") >= since).groupBy("month").agg(cases(), narratives())
    return months.withColumn("coverage_pct", F.round(100 * F.col("narratives") / F.col("complaints"), 2))


def thin_months(c: DataFrame, floor_pct: float = 5.0, since: str | None = None) -> DataFrame:
    """One row on the months whose narrative coverage is under the floor: how many, which span, complaints hidden."""
    months = c.where(F.col("month") >= since) if since else c
    months = months.groupBy("month").agg(cases(), narratives()).where(100 * F.col("narratives") < floor_pct * F.col("complaints"))
    return months.agg(F.count(F.lit(1)).alias("thin_months"), F.sum(F.col("complaints") - F.col("narratives")).alias("hidden"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def size_estimate(c: DataFrame, with_bytes: int = 2000, without_bytes: int = 250) -> DataFrame:
    """Download size by label: bytes per case with and without narrative."""
    per = c.groupBy("product").agg(cases(), narratives())
    return per.withColumn("bytes", F.col("narratives") * with_bytes + (F.col("complaints") - F.col("narratives")) * without_bytes)
