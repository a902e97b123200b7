"""Adapter from the provided star-schema tables to the complaint fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import normalize, text_hash
from casewright.storage import materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated cases of a company and a state, with the document of the same number as narrative."""
    text = F.coalesce("text", F.lit(""))
    return _cases(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", _told().alias("has_narrative"), text.alias("narrative")), F.coalesce("narrative", F.lit("")).alias("narrative"))


def facts(spark: SparkSession, sf_dir: str, min_tokens: int = 25) -> DataFrame:
    """The same cases with the hash of the normalised narrative (null: none or too short) in its place, written once.

    Texts are normalised at their own scan and never join, shuffle or reach a later plan.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    normal = d.select("doc_id", _told().alias("has_narrative"), F.when(_told() == 1, normalize(F.col("text"))).alias("norm"))
    hashed = normal.select("doc_id", "has_narrative", text_hash(F.col("norm"), min_tokens).alias("hash"))
    return materialize(_cases(spark, sf_dir, hashed, F.col("hash")), "facts")


def _told() -> Column:
    return F.when(F.col("text").isNull() | (F.trim("text") == ""), 0).otherwise(1)


def _cases(spark: SparkSession, sf_dir: str, told: DataFrame, *text: Column) -> DataFrame:
    """Orders with their customer's facts; ``told``: doc_id, has_narrative and the columns that ``text`` selects."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = spread(o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))
    day = F.to_date("o_orderdate")
    kind = F.col("o_custkey") % 4  # below 0 for negative keys
    suffix = F.when(kind == 0, ", INC.").when(kind == 1, " LLC").when(kind == 2, " Corp").otherwise(" Co.")
    response = F.when(F.col("o_orderstatus") == "F", "Closed with non-monetary relief").when(F.col("o_orderstatus") == "P", "Closed with explanation").otherwise("In progress")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(told, F.col("o_orderkey") == F.col("doc_id"), "left")
    return joined.select(
        F.col("o_orderkey").alias("complaint_id"), day.alias("date_received"), F.date_format(day, "yyyy-MM").alias("month"), F.col("c_mktsegment").alias("product"), F.lower("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("issue"), F.concat(F.lit("Company "), (F.col("o_custkey") % 40).cast("string"), suffix).alias("company"), F.col("n_name").alias("state"),
        F.concat(F.lpad((F.col("o_custkey") % 97).cast("string"), 3, "0"), F.lit("XX")).alias("zip_code"), F.col("o_orderpriority").alias("submitted_via"), response.alias("company_response"),
        F.coalesce("has_narrative", F.lit(0)).alias("has_narrative"), *text,
    )


def population(spark: SparkSession) -> DataFrame:
    """Twin of the population table for the fixture's states; ends in 1999, so later years carry it forward."""
    years = F.explode(F.sequence(F.lit(1995), F.lit(1999)))
    states = spark.range(24).select(F.col("id").cast("int").alias("k"), years.alias("year"))
    return states.select(F.concat(F.lit("NATION_"), F.col("k")).alias("state"), "year", ((F.col("k") + 1) * 100000 + (F.col("year") - 1995) * 1000).cast("long").alias("population"))


def scored(c: DataFrame, min_tokens: int = 25) -> DataFrame:
    """Cases with a narrative long enough to score, with its normalised text's hash and without the text.

    Cases that carry a hash already are only filtered. Others are hashed once and written, as
    everything built on them reads them more than once.
    """
    if "hash" in c.columns:
        return c.where("hash is not null")
    rows = c.where("has_narrative = 1").withColumn("norm", normalize(F.col("narrative"))).withColumn("hash", text_hash(F.col("norm"), min_tokens))
    return materialize(rows.drop("narrative", "norm"), "scored").where("hash is not null")
