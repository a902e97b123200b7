"""Sinks: CSV, JSON and month-partitioned parquet."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; arrays become JSON text. For results of report size."""
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            df = df.withColumn(name, F.to_json(name))
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_array(column: str, kind: str = "array<bigint>"):
    """An array column back from its JSON text."""
    return F.from_json(F.col(column), kind)


def write_months(df: DataFrame, path: str) -> None:
    """Replace the months present in ``df`` and leave the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def records(df: DataFrame) -> list[dict]:
    """Rows of a report-sized frame as plain values."""

    def plain(v):
        if isinstance(v, (dt.date, dt.datetime)):
            return v.isoformat()
        return float(v) if isinstance(v, Decimal) else [plain(x) for x in v] if isinstance(v, list) else v

    return [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def to_json(payload: dict, indent: int | None = None) -> str:
    return json.dumps(payload, indent=indent, default=str, separators=None if indent else (",", ":"))


def markdown_table(df: DataFrame, limit: int = 30) -> str:
    """A report-sized frame as a Markdown table."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["" if v is None else str(v) for v in r]) for r in rows)])
