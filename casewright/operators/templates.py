"""Texts filed again and again: exact groups, the template set and shares of templated cases.

Membership is retroactive: a text is a template if all its copies, over all months, reach
the minimum, so early copies count too. It is always computed from the counts of texts
and never stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE_MIN = 50


def template_set(s: DataFrame, template_min: int = TEMPLATE_MIN) -> DataFrame:
    """(hash, n) of the texts with at least ``template_min`` copies."""
    return s.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= template_min)


def flagged(s: DataFrame, template_min: int = TEMPLATE_MIN) -> DataFrame:
    """``s`` with ``templated`` 0 or 1.

    The set of templates is small beside the texts and joined as its size allows; copies of one
    text are never gathered, unlike with a window over the hash.
    """
    known = template_set(s, template_min).select(F.col("hash"), F.lit(1).alias("templated"))
    return s.join(known, "hash", "left").withColumn("templated", F.coalesce("templated", F.lit(0)))


def exact_duplicate_groups(s: DataFrame, min_size: int = 2, ids: int = 50) -> DataFrame:
    """Groups of equal normalised texts: size, firms and states (blank ones count), dates and the first ids."""
    groups = s.groupBy("hash").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("company").alias("companies"), F.count_distinct("state").alias("states"), F.min("date_received").alias("first_date"),
        F.max("date_received").alias("last_date"), F.min("complaint_id").alias("first_id"),
    ).where(F.col("size") >= min_size)
    # Ids are ranked, not collected: a group of a third of all cases still sends ``ids`` of them at most.
    members = s.select("hash", "complaint_id").join(groups.select("hash"), "hash", "left_semi")
    from casewright.operators.joins import first_k

    listed = first_k(members, ["hash"], ["complaint_id"], ids).groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list("complaint_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return groups.join(listed, "hash")


def headline(s: DataFrame, template_min: int = TEMPLATE_MIN) -> DataFrame:
    texts = s.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    big = F.col("n") >= template_min
    out = texts.agg(
        F.sum("n").alias("scored"), F.count(F.lit(1)).alias("distinct_texts"), F.count_if(big).alias("templates"), F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).alias("complaints_in_templates"),
        F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("exact_dup_any"),
    )
    return out.withColumn("dup_outside_templates", F.col("exact_dup_any") - F.col("complaints_in_templates"))


def templated_share(f: DataFrame, by: list[str]) -> DataFrame:
    """narratives, templated and pct (2 digits) of flagged cases by the given columns."""
    return f.groupBy(*by).agg(F.count(F.lit(1)).alias("narratives"), F.sum("templated").alias("templated")).withColumn("pct", F.round(100 * F.col("templated") / F.col("narratives"), 2))


def combined_share(f: DataFrame, floor: int = 150) -> DataFrame:
    """Share over all segments by month; null under ``floor`` narratives."""
    out = templated_share(f, ["month"])
    return out.withColumn("pct", F.when(F.col("narratives") >= floor, F.col("pct")))


BANDS = ((0, 90, "under 3 months"), (90, 365, "3-12 months"), (365, 730, "1-2 years"), (730, 100_000, "over 2 years"))


def lifespan(f: DataFrame) -> DataFrame:
    """Templates by time from first to last copy: how many, their cases, and the upper median of firms using one."""
    per = f.where("templated = 1").groupBy("hash").agg(F.min("date_received").alias("lo"), F.max("date_received").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("company").alias("firms"))
    days, band = F.datediff("hi", "lo"), None
    for i, (low, high, label) in enumerate(BANDS):
        hit = (days >= low) & (days < high)
        band = F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(label).alias("band"))) if band is None else band.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(label).alias("band")))
    per = per.withColumn("b", band).where("b is not null")
    # The upper median of integers is the value at rank floor(n / 2): counts per value keep it exact without a list per band.
    from pyspark.sql import Window

    w = Window.partitionBy("b").orderBy("firms")
    values = per.groupBy("b", "firms").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    values = values.withColumn("upto", F.sum("k").over(w)).withColumn("all", F.sum("k").over(Window.partitionBy("b")))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("firms"))).alias("median_firms")
    out = values.groupBy("b").agg(F.sum("k").alias("templates"), F.sum("n").alias("complaints"), median)
    every = f.sparkSession.createDataFrame([(i, label) for i, (_, _, label) in enumerate(BANDS)], "ord int, band string")
    out = out.select(F.col("b.band").alias("band"), "templates", "complaints", "median_firms")
    return F.broadcast(every).join(out, "band", "left").select("ord", "band", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("templates", "complaints", "median_firms")])


def long_lived_complaints(life: DataFrame) -> DataFrame:
    """Cases of templates that lived a year or longer."""
    return life.where("ord >= 2").agg(F.sum("complaints").alias("long_lived_complaints"))


def day_of_week(f: DataFrame, segment: str) -> DataFrame:
    """Share of each weekday (0 = Monday) among templated and organic cases, and the weekend's share."""
    days = f.where(F.col("segment") == segment).groupBy("templated", F.weekday("date_received").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("templated")
    total = F.sum("n").over(w)
    return days.select("templated", "weekday", "n", F.round(100 * F.col("n") / total, 2).alias("pct"), F.round(100 * F.sum(F.when(F.col("weekday") >= 5, F.col("n")).otherwise(0)).over(w) / total, 2).alias("weekend_pct"))


def top_templates(s: DataFrame, c: DataFrame, n: int = 12, chars: int = 300) -> DataFrame:
    """The ``n`` largest groups of equal texts with the narrative and issue of their smallest id, white space collapsed."""
    from casewright.functions.text import collapse_spaces

    top = s.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min("complaint_id").alias("complaint_id")).orderBy(F.desc("size"), "complaint_id").limit(n)
    found = c.join(F.broadcast(top), "complaint_id")
    return found.select("hash", "size", "complaint_id", "issue", F.substring(collapse_spaces(F.col("narrative")), 1, chars).alias("exemplar"))
