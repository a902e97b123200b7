"""Counts over time: scope predicates, monthly and daily counts, gap-free series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cases() -> Column:
    return F.count(F.lit(1)).alias("complaints")


def narratives() -> Column:
    return F.sum(F.col("has_narrative").cast("long")).alias("narratives")


def in_scope(segments=None, start: str | None = None, end: str | None = None) -> Column:
    """Segment among ``segments``, date between both ends inclusive; what is not given does not restrict."""
    parts = [F.lit(True)]
    if segments:
        parts.append(F.col("segment").isin(list(segments)))
    if start:
        parts.append(F.col("date_received") >= F.lit(start).cast("date"))
    if end:
        parts.append(F.col("date_received") <= F.lit(end).cast("date"))
    return reduce(lambda a, b: a & b, parts)


def in_months(start: str | None = None, end: str | None = None) -> Column:
    """Month between the months of both dates; prunes month partitions."""
    parts = [F.lit(True)]
    if start:
        parts.append(F.col("month") >= start[:7])
    if end:
        parts.append(F.col("month") <= end[:7])
    return reduce(lambda a, b: a & b, parts)


def complete_months(as_of: str | None) -> Column:
    """Months before that of ``as_of``; all without it."""
    return F.col("month") < as_of[:7] if as_of else F.lit(True)


def monthly_counts(c: DataFrame, by: str | None = None, as_of: str | None = None) -> DataFrame:
    keys = ["month", by] if by else ["month"]
    counts = c.where(complete_months(as_of)).groupBy(*keys).agg(cases(), narratives())
    return counts.withColumn("month_start", F.to_date(F.concat("month", F.lit("-01"))))


def daily_counts(c: DataFrame, by: str | None = None) -> DataFrame:
    return c.groupBy("date_received", *([by] if by else [])).agg(cases(), narratives())


def gap_filled(counts: DataFrame, entity: str | None = None, value: str = "complaints") -> DataFrame:
    """(entity, month_start, value) without gaps, from each entity's own first month to its last; 0 where nothing was counted."""
    keys = [entity] if entity else []
    spine = counts.groupBy(*keys).agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi")).where("lo is not null")
    spine = spine.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month_start"))
    there = counts.groupBy(*keys, "month_start").agg(F.sum(value).alias(value))
    return spine.join(there, [*keys, "month_start"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def per_segment_and_all(c: DataFrame, segments) -> DataFrame:
    """Monthly counts of each segment and, as ``ALL_SELECTED``, of their union, in one pass."""
    chosen = c.where(F.col("segment").isin(list(segments)))
    sets = chosen.select("segment", "month", "has_narrative").groupingSets([("segment", "month"), ("month",)], "segment", "month").agg(cases(), narratives())
    return sets.withColumn("segment", F.coalesce("segment", F.lit("ALL_SELECTED")))


def against_others(c: DataFrame, segment: str, since: str = "2012-01") -> DataFrame:
    """Per month in which ``segment`` has cases: its count, that of all other segments together, and the decimal logarithm of both (null for 0)."""
    mine = F.col("segment") == segment
    out = c.where((F.col("month") >= since) & F.col("segment").isNotNull()).groupBy("month").agg(F.count_if(mine).alias("complaints"), F.count_if(~mine).alias("others")).where("complaints > 0")
    return out.withColumns({f"log_{n}": F.when(F.col(n) > 0, F.log10(n)) for n in ("complaints", "others")})
