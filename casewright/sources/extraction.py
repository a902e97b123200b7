"""Extraction in passes by narrative flag, window by window, with a ledger that lets a run go on where the last one ended."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import schema
from casewright.sources.readers import filter_key, pending_windows, plan_windows

# Rows a request should bring, for cases with and without narrative; days that are always fetched again.
WITH_ROWS, WITHOUT_ROWS = 25_000, 75_000
RECENT_DAYS = 60
#: (flag, rows per window) of each pass of a mode; a null flag takes all cases.
PASSES = {"split": ((1, WITH_ROWS), (0, WITHOUT_ROWS)), "with": ((1, WITH_ROWS),), "without": ((0, WITHOUT_ROWS),), "any": ((None, WITH_ROWS),)}

_PLAN = "filter_key string, flag int, window_start date, window_end date, expected long"


def plan(source: DataFrame, products: list[str], start: str, end: str, mode: str = "split", passes=PASSES) -> DataFrame:
    """(filter_key, flag, window_start, window_end, expected) of every pass.

    Cases are counted per day and flag by Spark; the driver sees those counts only, at most two for each day of the span.
    """
    if mode not in passes:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(passes)}")
    counts = _scope(source, products, start, end).groupBy("date_received", "has_narrative").agg(F.count(F.lit(1)).alias("n")).collect()
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    rows = []
    for flag, target in passes[mode]:
        daily: dict[dt.date, int] = {}
        for r in counts:
            if flag is None or r.has_narrative == flag:
                daily[r.date_received] = daily.get(r.date_received, 0) + r.n
        key = filter_key(products, {None: "any", 0: "false", 1: "true"}[flag])
        rows += [(key, flag, a, b, n) for a, b, n in plan_windows(list(daily.items()), first, last, target)]
    return source.sparkSession.createDataFrame(rows, _PLAN)


def _scope(source: DataFrame, products: list[str], start: str, end: str) -> DataFrame:
    return source.where(F.col("product").isin(products) & F.col("date_received").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def extract(source: DataFrame, windows: DataFrame, products: list[str]) -> DataFrame:
    """Cases of ``source`` in ``windows``, each with its window's filter_key, window_start and window_end.

    The windows of a pass do not overlap, so a day and a flag have one window: they meet by equality, and the broadcast side has at most two rows a day.
    """
    flags = F.when(F.col("flag").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array("flag"))
    days = windows.select("filter_key", "window_start", "window_end", F.explode(flags).alias("has_narrative"), F.sequence("window_start", "window_end").alias("_days"))
    days = days.select("filter_key", "window_start", "window_end", "has_narrative", F.explode("_days").alias("date_received"))
    return source.where(F.col("product").isin(products)).join(F.broadcast(days), ["has_narrative", "date_received"])


def entries(windows: DataFrame, fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Ledger rows of ``windows``: cases received, and those whose id is not among ``stored``."""
    key = ["filter_key", "window_start", "window_end"]
    old = stored.select("complaint_id").distinct().withColumn("_old", F.lit(1))
    counts = fetched.select(*key, "complaint_id").join(old, "complaint_id", "left").groupBy(*key).agg(F.count(F.lit(1)).alias("received"), F.count_distinct(F.when(F.col("_old").isNull(), F.col("complaint_id"))).alias("inserted"))
    out = windows.join(F.broadcast(counts), key, "left").withColumn("fetched_at", F.current_timestamp())
    return out.select(*key, "expected", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("received", "inserted")], "fetched_at")


def pending(windows: DataFrame, ledger: DataFrame, end: str, resume: bool = True, recent_days: int = RECENT_DAYS) -> DataFrame:
    """The windows a run has to fetch: without ``resume`` all of them."""
    return pending_windows(windows, ledger, end, recent_days) if resume else windows


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below ``path``; empty before the first run. Runs append to it, after their cases are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema.LEDGER).parquet(path) if there else spark.createDataFrame([], schema.LEDGER)
