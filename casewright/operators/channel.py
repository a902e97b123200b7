"""Intake channels over time, in long form; ``pivoted`` gives the wide one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def channel_mix(c: DataFrame, freq: str = "month") -> DataFrame:
    """(period, channel, n, total, share); channels not seen in a period have no row."""
    period = F.col("month") if freq == "month" else F.substring("month", 1, 4)
    counts = c.groupBy(period.alias("period"), F.col("submitted_via").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("period"))
    return counts.withColumn("total", total).withColumn("share", F.col("n") / F.col("total"))


def pivoted(mix: DataFrame, channels: list[str]) -> DataFrame:
    """One row per period with counts and shares of the given channels, 0 where absent."""
    one = lambda ch, what: F.coalesce(F.max(F.when(F.col("channel") == ch, F.col(what))), F.lit(0)).alias(ch if what == "n" else f"{ch}_share")
    return mix.groupBy("period").agg(F.max("total").alias("total"), *[one(ch, w) for ch in channels for w in ("n", "share")])


def channel_shift(c: DataFrame, date: str, months: int = 18) -> DataFrame:
    """Channels before and after a date: mean of monthly shares (absent months count 0), volumes, changes.

    before: month starts in [date - months, date); after: in [date, date + months].
    """
    cut = F.lit(date).cast("date")
    mix = channel_mix(c).withColumn("at", F.to_date(F.concat("period", F.lit("-01"))))
    side = F.when((F.col("at") >= F.add_months(cut, -months)) & (F.col("at") < cut), "pre").when((F.col("at") >= cut) & (F.col("at") <= F.add_months(cut, months)), "post")
    mix = mix.withColumn("side", side)
    lengths = mix.where("side is not null").agg(F.count_distinct(F.when(F.col("side") == "pre", F.col("at"))).alias("pre_months"), F.count_distinct(F.when(F.col("side") == "post", F.col("at"))).alias("post_months"))
    total = lambda s, what: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(what))), F.lit(0))
    out = mix.groupBy("channel").agg(*[total(s, w).alias(f"{s}_{w}") for s in ("pre", "post") for w in ("share", "n")]).join(F.broadcast(lengths)).where("pre_months > 0 and post_months > 0")
    pre, post = F.col("pre_share") / F.col("pre_months"), F.col("post_share") / F.col("post_months")
    return out.select(
        "channel", F.round(pre, 5).alias("pre_share"), F.round(post, 5).alias("post_share"), F.round((post - pre) * 100, 3).alias("share_change_pp"), F.col("pre_n").cast("long").alias("pre_complaints"),
        F.col("post_n").cast("long").alias("post_complaints"), F.when(F.col("pre_n") > 0, F.round((F.col("post_n") / F.col("pre_n") - 1) * 100, 1)).alias("pct_volume_change"),
    )
