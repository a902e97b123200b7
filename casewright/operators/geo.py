"""Rates per head by state and year, their anomalies and changes, concentration by ZIP area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import dims
from casewright.operators.series import in_scope
from casewright.operators.windows import group_robust_z
from casewright.storage import small


def state_year_rates(c: DataFrame, population: DataFrame, segments=None, start=None, end=None, non_states=dims.NON_STATES) -> DataFrame:
    """Complaints per 100,000 by state and year.

    A (state, year) without population takes the state's figure of the table's latest year and is
    flagged; states unknown to the table are dropped.
    """
    counts = c.where(in_scope(segments, start, end)).where(~F.col("state").isin(list(non_states))).groupBy("state", F.year("date_received").alias("year")).agg(F.count(F.lit(1)).alias("complaints"))
    latest = population.join(F.broadcast(population.agg(F.max("year").alias("year"))), "year", "left_semi").select("state", F.col("population").alias("latest"))
    out = counts.join(small(population), ["state", "year"], "left").join(small(latest), "state", "left")
    out = out.withColumn("carried_forward", F.col("population").isNull()).withColumn("population", F.coalesce("population", "latest")).where("population is not null").drop("latest")
    return out.withColumn("rate_per_100k", F.col("complaints") / F.col("population") * 100000)


def excluded_count(c: DataFrame, segments=None, start=None, end=None, non_states=dims.NON_STATES) -> DataFrame:
    return c.where(in_scope(segments, start, end)).agg(F.count_if(F.col("state").isin(list(non_states))).alias("excluded"))


def rate_anomalies(rates: DataFrame, min_year: int | None = None) -> DataFrame:
    rates = rates.where(F.col("year") >= min_year) if min_year else rates
    return group_robust_z(rates, ["year"], "rate_per_100k")


def state_rate_changes(c: DataFrame, population: DataFrame, date: str, segments=None, years: int = 2, non_states=dims.NON_STATES) -> DataFrame:
    """Change of each state's mean yearly rate from before to from ``date`` on, and its excess over the sum of all states."""
    spark = c.sparkSession
    start, before, end = spark.sql(f"select cast(add_months(date'{date}', {-12 * years}) as string), cast(date_sub(date'{date}', 1) as string), cast(add_months(date'{date}', {12 * years}) as string)").first()
    mean = lambda a, b, name: state_year_rates(c, population, segments, a, b, non_states).groupBy("state").agg(F.avg("rate_per_100k").alias(name))
    both = mean(start, before, "pre_rate").join(mean(date, end, "post_rate"), "state")
    both = both.withColumn("pct_change", (F.col("post_rate") / F.col("pre_rate") - 1) * 100)
    national = both.agg(((F.sum("post_rate") / F.sum("pre_rate") - 1) * 100).alias("national_pct_change"))
    return both.join(F.broadcast(national)).withColumn("excess_pp", F.col("pct_change") - F.col("national_pct_change"))


def zip_concentration(c: DataFrame, min_complaints: int = 500, non_states=dims.NON_STATES) -> DataFrame:
    """Per state: number of ZIP3 areas, Herfindahl index of their shares, the largest area (ties: the smaller code) and its share."""
    zip3 = F.substring("zip_code", 1, 3)
    areas = c.where(~F.col("state").isin(list(non_states)) & (F.length(zip3) == 3)).groupBy("state", zip3.alias("zip3")).agg(F.count(F.lit(1)).alias("n"))
    # Sum of squared shares = sum of squares over the squared sum, so one aggregation does.
    out = areas.groupBy("state").agg(
        F.sum("n").alias("complaints"), F.count(F.lit(1)).alias("zip3_count"), F.sum(F.col("n") * F.col("n")).alias("_squares"), F.min(F.struct((-F.col("n")).alias("n"), "zip3")).alias("_top")
    ).where(F.col("complaints") >= min_complaints)
    total = F.col("complaints")
    return out.select("state", "complaints", "zip3_count", F.round(F.col("_squares") / (total * total), 4).alias("hhi"), F.col("_top.zip3").alias("top_zip3"), F.round(-F.col("_top.n") / total, 4).alias("top_share"))


def rate_vs_templating(c: DataFrame, flagged: DataFrame, population: DataFrame, segment: str, year: int, floor: int = 200, non_states=dims.NON_STATES) -> DataFrame:
    """Rate of one year beside the templated share over all years, per state with at least ``floor`` narratives."""
    totals = c.where((F.col("segment") == segment) & F.col("month").startswith(f"{year}-")).groupBy("state").agg(F.count(F.lit(1)).alias("complaints"))
    shares = flagged.where(F.col("segment") == segment).groupBy("state").agg(F.count(F.lit(1)).alias("narratives"), F.sum("templated").alias("templated")).where(F.col("narratives") >= floor)
    latest = population.join(F.broadcast(population.agg(F.max("year").alias("year"))), "year", "left_semi").select("state", "population")
    out = totals.where(~F.col("state").isin(list(non_states))).join(F.broadcast(latest), "state").join(shares, "state")
    return out.select("state", "complaints", F.round(F.col("complaints") / F.col("population") * 100000, 1).alias("rate_per_100k"), "narratives", F.round(100 * F.col("templated") / F.col("narratives"), 1).alias("templated_pct"))


def pearson(x: str, y: str) -> Column:
    """Pearson's r; null where either side does not vary (``corr`` would divide by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r, null for two rows or fewer."""
    return df.agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r")).select("n", F.when(F.col("n") > 2, F.col("r")).alias("r"))
