"""Tables of the operators: intermediate ones in the shared folder, inputs, joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.storage import discard, materialize, release, shared_dir, spread

__all__ = ["discard", "hot_join", "materialize", "release", "shared_dir", "spread", "table", "unused"]

#: Tasks over which the rows of one hot key are dealt.
SALTS = 64


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until no column is called so, in capitals or not."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def hot_join(rows: DataFrame, facts: DataFrame, key: str, by: str, lone: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key), where one key may hold any share of ``rows``.

    Rows of a key are dealt by their ``by`` column over ``SALTS`` places and the key's facts sent
    to each of them. A key with a single row needs no copies: ``lone`` is that row's ``by``
    (null for keys with several rows, or where it is null itself).
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(SALTS - 1))
    facts = facts.withColumn("_place", F.explode(F.when(lone.isNotNull(), F.array(place(lone))).otherwise(everywhere)))
    return rows.withColumn("_place", place(F.col(by))).join(facts, [key, "_place"], how).drop("_place")
