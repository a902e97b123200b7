"""Sources: the public extract's CSV files, parquet and population tables; a planned range source; nested JSON buckets."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schema
from casewright.functions.names import with_segment


def extract_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Complaints of an extract file, inclusive of both dates; unknown columns are dropped, missing ones blank.

    Rows without a numeric id or a ten-character date are dropped.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = {h: schema.EXTRACT_HEADERS[h] for h in raw.columns if h in schema.EXTRACT_HEADERS}
    rows = raw.select(*[F.col(f"`{h}`").alias(n) for h, n in names.items()])
    for n in schema.EXTRACT_HEADERS.values():
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(""))
    return shape_extract(rows, start, end)


def shape_extract(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Typed complaints from rows of strings: blanks for nulls, month, segment and narrative flag derived."""
    day = F.substring("date_received", 1, 10)
    rows = rows.where(F.trim("complaint_id").rlike("^[0-9]+$") & (F.length(day) == 10) & F.try_to_date(day).isNotNull())
    narrative = F.regexp_replace(F.coalesce("narrative", F.lit("")), r"^\s+|\s+$", "")
    blanks = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("sub_product", "issue", "sub_issue", "company", "state", "zip_code", "tags", "submitted_via", "company_response", "company_public_response", "timely")]
    out = rows.select(
        F.trim("complaint_id").cast("long").alias("complaint_id"), F.try_to_date(day).alias("date_received"), F.substring(day, 1, 7).alias("month"), "product", *blanks,
        F.substring(F.coalesce("date_sent_to_company", F.lit("")), 1, 10).alias("date_sent_to_company"), F.when(narrative == "", 0).otherwise(1).alias("has_narrative"), narrative.alias("narrative"),
    )
    if start:
        out = out.where(F.col("date_received") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date_received") <= F.lit(end).cast("date"))
    return with_segment(out).select(*schema.COMPLAINTS.fieldNames())


def population_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.POPULATION).option("header", True).option("mode", "FAILFAST").csv(path)


def population_long(*vintages: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """(state, year, population) from wide census tables, later arguments winning; state rows and four-digit years only.

    ``abbreviations``: (name, state); without it names are kept.
    """
    parts = []
    for i, wide in enumerate(vintages):
        years = [c for c in wide.columns if len(c) == 15 and c.startswith("POPESTIMATE") and c[11:].isdigit()]
        rows = wide.where("SUMLEV = '040'").select(F.trim("NAME").alias("name"), *[F.col(c).cast("string").alias(c) for c in years])
        long = rows.unpivot(["name"], years, "year", "population").where(F.trim("population").rlike("^[0-9]+$"))
        parts.append(long.select("name", F.substring("year", 12, 4).cast("int").alias("year"), F.trim("population").cast("long").alias("population"), F.lit(i).alias("vintage")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("name", "year").agg(F.max_by("population", "vintage").alias("population"))
    if abbreviations is None:
        return rows.select(F.col("name").alias("state"), "year", "population")
    return rows.join(F.broadcast(abbreviations), "name").select("state", "year", "population")


def buckets_in(node) -> list[dict] | None:
    """The first list under a key ``buckets``, looking into objects in their order, at any depth."""
    todo = [node]
    while todo:
        here = todo.pop()
        if isinstance(here, dict):
            if isinstance(here.get("buckets"), list):
                return here["buckets"]
            todo += reversed(here.values())
    return None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("doc_count", T.LongType())])))
def _found_buckets(texts: pd.Series) -> pd.Series:
    def entries(text):
        try:
            found = buckets_in(json.loads(text)) if text else None
        except ValueError:
            return None
        text_of = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        return None if found is None else [{"key": text_of(b.get("key")), "doc_count": b.get("doc_count")} for b in found if isinstance(b, dict)]

    return texts.map(entries)


def find_buckets(json_text: Column) -> Column:
    """(key, doc_count) entries of the first ``buckets`` list of a response, at any depth; null without one.

    No built-in function searches a document of unknown depth, so this is Python over Arrow batches of responses.
    """
    return _found_buckets(json_text)


def bucket_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, key, doc_count) for each of ``fields`` in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields])).alias("p")
    return df.select(pairs).groupBy("p.field", "p.key").agg(F.count(F.lit(1)).alias("doc_count"))


def plan_windows(daily: list[tuple[dt.date, int]], start: dt.date, end: dt.date, target_rows: int = 40_000, min_days: int = 1, first_days: int = 90) -> list[tuple[dt.date, dt.date, int]]:
    """Date windows of about ``target_rows`` each from counts per day; empty ones are left out.

    A window over the target shrinks in proportion; the next one starts as wide as the last density suggests (1 to 365 days).
    """
    counts, out, at, span = dict(daily), [], start, first_days
    count = lambda a, b: sum(counts.get(a + dt.timedelta(i), 0) for i in range((b - a).days + 1))
    while at <= end:
        last = min(end, at + dt.timedelta(span - 1))
        n = count(at, last)
        width = (last - at).days + 1
        if n > target_rows and width > min_days:
            span = max(min_days, min(width - 1, int(width * target_rows / n)))
            continue
        if n:
            out.append((at, last, n))
        density = n / width
        span = max(1, min(365, int(target_rows / density))) if density else 365
        at = last + dt.timedelta(1)
    return out


def split_overflow(windows, daily: dict, per_product: dict, cap: int = 100_000) -> list[tuple]:
    """(start, end, product or None, rows) with no slice over ``cap``: bisected by date, then one day by product; what stays over has rows -1."""
    out, todo = [], list(windows)
    while todo:
        a, b, *_ = todo.pop(0)
        days = [a + dt.timedelta(i) for i in range((b - a).days + 1)]
        n = sum(daily.get(d, 0) for d in days)
        if n <= cap:
            out.append((a, b, None, n))
        elif len(days) > 1:
            mid = days[(len(days) - 1) // 2]
            todo[:0] = [(a, mid), (mid + dt.timedelta(1), b)]
        else:
            out += [(a, a, p, m if m <= cap else -1) for p, m in sorted(per_product.get(a, {}).items())]
    return out


def filter_key(products: list[str], has_narrative: str) -> str:
    """Fingerprint of a filter: twelve hex digits over the sorted labels and the narrative flag."""
    import hashlib

    return hashlib.sha1("|".join([has_narrative, *sorted(products)]).encode()).hexdigest()[:12]


def pending_windows(windows: DataFrame, ledger: DataFrame, end, recent_days: int = 60) -> DataFrame:
    """Windows not in the ledger, and those that end within ``recent_days`` of ``end`` in any case."""
    done = ledger.where(F.col("received") >= 0).select("filter_key", "window_start", "window_end").where(F.col("window_end") < F.date_sub(F.lit(end).cast("date"), recent_days))
    return windows.join(done, ["filter_key", "window_start", "window_end"], "left_anti")
