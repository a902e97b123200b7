"""Company names and product labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import dims

_FORMS = "( (" + "|".join(sorted(dims.LEGAL_FORMS, key=lambda s: (-len(s), s))) + "))+$"


def normalize_company(name: Column) -> Column:
    """Comparison key: upper case, no punctuation, & as AND, no leading THE, no trailing legal forms; null is empty.

    The longest run of legal forms at the end is stripped at once, so the result does not
    depend on any order of the forms.
    """
    text = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[.,;:'\"()\[\]/\\]+", " ")
    text = F.replace(text, F.lit("&"), F.lit(" AND "))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(text, "^THE ", "")
    return F.trim(F.regexp_replace(text, _FORMS, ""))


def with_company_group(df: DataFrame, column: str = "company", to: str = "company_group") -> DataFrame:
    """Add the corporate group: the alias of the normalised name, else the normalised name."""
    alias = F.broadcast(dims.aliases(df.sparkSession).select(F.col("key").alias("_key"), F.col("grp").alias("_grp")))
    keyed = df.withColumn("_key", normalize_company(F.col(column)))
    return keyed.join(alias, "_key", "left").withColumn(to, F.coalesce("_grp", "_key")).drop("_key", "_grp")


def _strip(label: Column) -> Column:
    return F.regexp_replace(label, r"(?U)^\s+|\s+$", "")


def with_segment(df: DataFrame, column: str = "product", to: str = "segment") -> DataFrame:
    """Add the canonical segment of a raw label: exact or case-insensitive, else ``unmapped:`` and the label."""
    known = dims.segment_labels(df.sparkSession).select(F.lower("label").alias("_low"), F.col("segment").alias("_segment"))
    keyed = df.withColumn("_low", F.lower(_strip(F.col(column))))
    blank = F.col(column).isNull() | (F.col(column) == "")
    found = F.when(blank, "unmapped:<blank>").otherwise(F.coalesce("_segment", F.concat(F.lit("unmapped:"), _strip(F.col(column)))))
    return keyed.join(F.broadcast(known), "_low", "left").withColumn(to, found).drop("_low", "_segment")


def raw_labels(segments) -> list[str]:
    """Raw labels of the given segments; an unknown one raises KeyError."""
    for s in segments:
        if s not in dims.SEGMENTS:
            raise KeyError(f"unknown segment {s!r}; known: {sorted(dims.SEGMENTS)}")
    return [raw for s in segments for raw in dims.SEGMENTS[s]]


def unmapped_labels(df: DataFrame, column: str = "product") -> DataFrame:
    """Distinct non-blank labels that no segment covers, in either case."""
    return with_segment(df.select(column).where(F.col(column) != "").distinct(), column).where(F.col("segment").startswith("unmapped:")).select(column)


def display_name(name: Column) -> Column:
    """Presentable company group: names in capitals are title-cased, small words and short initialisms apart."""
    words = F.split(name, " ")
    small = ["of", "and", "the", "for", "de", "at"]

    def shown(word: Column, i: Column) -> Column:
        low = F.lower(word)
        short = (i == 0) & (F.length(word) <= 3) & word.rlike("^[A-Za-z]+$") & ~low.isin(small)
        return F.when(short, word).when(low.isin(small) & (i > 0), low).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000))))

    capitals = (name == F.upper(name)) & name.rlike("[A-Z]")
    return F.when(capitals, F.array_join(F.transform(words, shown), " ")).otherwise(name)
