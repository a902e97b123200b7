"""Composition and outcome questions asked of templated and organic cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import dims
from casewright.operators.geo import pearson
from casewright.operators.joins import first_k
from casewright.storage import small


def issue_topk(c: DataFrame, by: Column, k: int = 6) -> DataFrame:
    """The k most frequent issues of each group (ties: issue)."""
    counts = c.groupBy(by.alias("grp"), "issue").agg(F.count(F.lit(1)).alias("n"))
    return first_k(counts, ["grp"], [F.desc("n"), "issue"], k)


def channel_by_year(c: DataFrame) -> DataFrame:
    return c.groupBy(F.year("date_received").alias("year"), "submitted_via").agg(F.count(F.lit(1)).alias("n"))


def geo_split(flagged: DataFrame, population: DataFrame, segment: str, year: int, floor: int = 200, non_states=dims.NON_STATES) -> DataFrame:
    """Templated and organic cases per 100,000 by state, for states with at least ``floor`` of both together."""
    per = flagged.where((F.col("segment") == segment) & F.col("month").startswith(f"{year}-")).groupBy("state").agg(F.sum("templated").alias("templated"), F.sum(1 - F.col("templated")).alias("organic"))
    latest = population.join(F.broadcast(population.agg(F.max("year").alias("year"))), "year", "left_semi").select("state", "population")
    per = per.where(~F.col("state").isin(list(non_states)) & (F.col("templated") + F.col("organic") >= floor)).join(small(latest), "state")
    rate = lambda c: (F.col(c) / F.col("population") * 100000).alias(f"{c}_per_100k")
    return per.select("state", "templated", "organic", rate("templated"), rate("organic"))


def rate_ratio(split: DataFrame) -> DataFrame:
    """Templated over organic rate by state, the denominator at least 0.01."""
    return split.withColumn("ratio", F.col("templated_per_100k") / F.greatest("organic_per_100k", F.lit(0.01)))


def geo_split_stats(split: DataFrame) -> DataFrame:
    """Spread of both rates over states: largest over smallest, coefficient of variation (population deviation), correlation."""
    stats = [(F.max(f"{c}_per_100k") / F.greatest(F.min(f"{c}_per_100k"), F.lit(1e-9))).alias(f"{c}_max_min") for c in ("templated", "organic")]
    stats += [F.try_divide(F.stddev_pop(f"{c}_per_100k"), F.avg(f"{c}_per_100k")).alias(f"{c}_cv") for c in ("templated", "organic")]
    return split.agg(F.count(F.lit(1)).alias("states"), *stats, pearson("templated_per_100k", "organic_per_100k").alias("r"))


def relief_mix(flagged: DataFrame, year: int) -> DataFrame:
    """Outcomes of closed cases by segment and kind, in one pass over all segments."""
    closed = flagged.where(F.col("month").startswith(f"{year}-") & ~F.col("company_response").isin(list(dims.NON_FINAL)))
    share = lambda *r, d=2: F.round(100 * F.count_if(F.col("company_response").isin(list(r))) / F.count(F.lit(1)), d)
    return closed.groupBy("segment", "templated").agg(
        F.count(F.lit(1)).alias("n"), share(*dims.RELIEF).alias("relief_pct"), share(dims.MONETARY, d=3).alias("monetary_pct"), share(dims.NON_MONETARY).alias("nonmonetary_pct"), share(dims.EXPLANATION).alias("explanation_pct")
    )


def relief_breakdown(flagged: DataFrame, year: int, k: int = 6) -> DataFrame:
    closed = flagged.where(F.col("month").startswith(f"{year}-") & ~F.col("company_response").isin(list(dims.NON_FINAL)))
    counts = closed.groupBy("segment", "templated", "company_response").agg(F.count(F.lit(1)).alias("n"))
    return first_k(counts, ["segment", "templated"], [F.desc("n"), "company_response"], k)


def relief_factor(mix: DataFrame) -> DataFrame:
    """Organic over templated relief share by segment, the denominator at least 0.01."""
    side = lambda k: F.max(F.when(F.col("templated") == k, F.col("relief_pct")))
    out = mix.groupBy("segment").agg(side(1).alias("templated_pct"), side(0).alias("organic_pct")).where("templated_pct is not null and organic_pct is not null")
    return out.withColumn("factor", F.col("organic_pct") / F.greatest("templated_pct", F.lit(0.01)))


def named(column: str, *parts: str) -> Column:
    """Whether the column contains one of the parts, in any case."""
    found = F.lit(False)
    for p in parts:
        found = found | F.col(column).ilike(f"%{p}%")
    return found


def respondent_monthly(c: DataFrame, *parts: str, more_than: int = 20) -> DataFrame:
    return c.where(named("company", *parts)).groupBy("month").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def product_issue_topk(c: DataFrame, *parts: str, year: int, k: int = 6) -> DataFrame:
    counts = c.where(named("company", *parts) & F.col("month").startswith(f"{year}-")).groupBy("product", "issue").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "product", "issue").limit(k)


def samples(c: DataFrame, *parts: str, month_prefix: str, k: int = 3, chars: int = 320) -> DataFrame:
    """The first ``k`` narratives by id of matching firms and months."""
    rows = c.where(named("company", *parts) & (F.col("has_narrative") == 1) & F.col("month").startswith(month_prefix))
    return rows.orderBy("complaint_id").limit(k).select("complaint_id", "date_received", "state", "issue", F.substring("narrative", 1, chars).alias("txt"))


def tail_daily(c: DataFrame, since: str) -> DataFrame:
    return c.where(F.col("date_received") >= F.lit(since).cast("date")).groupBy("date_received").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_narrative").cast("long")).alias("narr"))
