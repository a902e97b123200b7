"""Volume bursts of firms and segments against their own past, and new entrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.names import with_company_group
from casewright.operators.joins import closest, within_days
from casewright.operators.series import gap_filled, monthly_counts
from casewright.operators.windows import trailing_robust_z


def folded_monthly(c: DataFrame, as_of: str | None = None, fold: bool = True) -> DataFrame:
    """Monthly counts per company group; names are normalised once per distinct name and month."""
    counts = monthly_counts(c, "company", as_of)
    if not fold:
        return counts.withColumnRenamed("company", "entity")
    counts = with_company_group(counts).groupBy(F.col("company_group").alias("entity"), "month", "month_start")
    return counts.agg(F.sum("complaints").alias("complaints"), F.sum("narratives").alias("narratives"))


def company_bursts(c: DataFrame, as_of: str | None = None, min_monthly: int = 50, z: float = 5.0, window: int = 12, fold: bool = True) -> DataFrame:
    """Months in which a firm's volume is at least ``z`` and ``min_monthly``; firms that never reach the volume are dropped first."""
    counts = folded_monthly(c, as_of, fold).where("entity <> ''")
    busy = counts.groupBy("entity").agg(F.max("complaints").alias("_m")).where(F.col("_m") >= min_monthly).drop("_m")
    series = gap_filled(counts.join(busy, "entity", "left_semi"), "entity")
    scored = trailing_robust_z(series, ["entity"], "month_start", "complaints", window)
    hits = scored.where((F.col("z") >= z) & (F.col("complaints") >= min_monthly))
    return hits.withColumn("multiple", F.when(F.col("baseline") > 0, F.round(F.col("complaints") / F.col("baseline"), 2))).orderBy(F.desc("z"), "entity", "month_start")


def explain_bursts(bursts: DataFrame, events: DataFrame, days: int = 120) -> DataFrame:
    """Add the group's closest event within ``days`` of the burst month's 15th (ties: date, description)."""
    events = events.select(F.col("grp").alias("entity"), "event_date", "description")
    found = within_days(bursts, events, F.date_add("month_start", 14), days, ["entity"])
    return closest(found, ["entity", "month_start"], [F.col("gap").asc_nulls_last(), "event_date", "description"])


def explained(bursts: DataFrame) -> DataFrame:
    return bursts.agg(F.count(F.lit(1)).alias("bursts"), F.count_if(F.coalesce("description", F.lit("")) != "").alias("explained"))


def segment_bursts(c: DataFrame, as_of: str | None = None, z: float = 3.0, window: int = 12) -> DataFrame:
    series = gap_filled(monthly_counts(c, "segment", as_of), "segment")
    hits = trailing_robust_z(series, ["segment"], "month_start", "complaints", window).where(F.col("z") >= z)
    return hits.withColumn("multiple", F.when(F.col("baseline") > 0, F.round(F.col("complaints") / F.col("baseline"), 2))).orderBy(F.desc("z"), "segment", "month_start")


def new_entrants(c: DataFrame, segments=None, min_first_month: int = 200) -> DataFrame:
    """Firms whose first month is large.

    The first month and the total are taken over all segments, the first month's count within the
    given ones; a firm first seen outside them is not reported.
    """
    inside = F.col("segment").isin(list(segments)) if segments else F.lit(True)
    per = c.where("company <> ''").groupBy("company", "month").agg(F.count_if(inside).alias("first_month_complaints"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("company")
    per = per.withColumn("first_month", F.min("month").over(w)).withColumn("total", F.sum("n").over(w))
    return per.where((F.col("month") == F.col("first_month")) & (F.col("first_month_complaints") >= min_first_month)).select("company", "first_month", "first_month_complaints", "total").orderBy(F.desc("first_month_complaints"), "company")


def lockstep(c: DataFrame, last_month: str, months: int = 12) -> DataFrame:
    """Ratio of the last to the first month's volume of each firm over ``months`` months up to ``last_month``."""
    start = F.date_format(F.add_months(F.lit(last_month + "-01").cast("date"), 1 - months), "yyyy-MM")
    per = c.where((F.col("month") >= start) & (F.col("month") <= last_month)).groupBy("company", "month").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("company").agg(F.min_by("n", "month").alias("first_n"), F.max_by("n", "month").alias("last_n"))
    return out.withColumn("ratio", F.col("last_n") / F.col("first_n"))
