"""Reusable joins: interval, nearest, top-k and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_days(left: DataFrame, events: DataFrame, day: Column, days: int, on: list[str] | None = None, how: str = "left") -> DataFrame:
    """``left`` with every event (event_date, description) within ``days`` of ``day``, of equal ``on`` columns; adds ``gap``.

    Days are cut into blocks as long as an event's reach, which therefore touches two at most: both
    sides meet by block, so neither has to be small and Spark broadcasts one only by its size.
    """
    block = lambda d: F.floor(F.unix_date(d.cast("date")) / (2 * days + 1))
    reach = F.array_distinct(F.array(block(F.date_sub("event_date", days)), block(F.date_add("event_date", days))))
    left, events = left.withColumn("_day_block", block(day)), events.withColumn("_event_block", F.explode(reach))
    gap = F.abs(F.datediff(day, F.col("event_date")))
    near = (F.col("_day_block") == F.col("_event_block")) & (gap <= days)
    for c in on or []:
        near = (left[c] == events[c]) & near
    out = left.join(events, near, how).withColumn("gap", gap)
    for c in on or []:
        out = out.drop(events[c])
    return out.drop("_day_block", "_event_block")


def closest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def nearest_event(df: DataFrame, events: DataFrame, day: Column) -> DataFrame:
    """``df`` with the nearest of ``events`` (ord, name, event_date; a fixed list) and its gap in days; ties go to the first listed.

    Each row meets the whole fixed list, so this is a scan with an array, not a join of tables.
    """
    listed = events.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "event_date"))).alias("_events"))
    gaps = F.transform("_events", lambda e: F.struct(F.abs(F.datediff(day, e["event_date"])).alias("gap"), e["ord"].alias("ord"), e["name"].alias("name")))
    best = F.array_min(gaps)
    return df.join(F.broadcast(listed)).withColumn("_best", best).withColumn("nearest_event", F.col("_best.name")).withColumn("nearest_gap", F.col("_best.gap")).drop("_best", "_events")


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key (Spark prunes each task's rows to k per key before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def ends(df: DataFrame, order: list, first: int, last: int) -> DataFrame:
    """The first and last rows of a report-sized frame in ``order``."""
    n = Window.orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(n)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where((F.col("_rn") <= first) | (F.col("_rn") > F.col("_all") - last)).drop("_rn", "_all")
