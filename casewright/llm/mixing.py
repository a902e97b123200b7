"""Mixing sources to target weights: Efraimidis-Spirakis order, prefix-summed to word budgets.

Everything is DataFrame functions. A document's key is -ln(u) / w, with u from a digest of
its id and w its quality weight in [1, 4]; sorting by it draws without replacement in
proportion to w. A source's budget first buys complete epochs; the rest takes the documents
of the key order while they fit, and a second pass over those that fit the remaining gap
closes it to the nearest document.

Prefix sums run in two levels - key-range buckets within a source, then rows within a
bucket - so a source with a third of all rows is spread over many tasks. (w >= 1 bounds a
bucket's share of rows at four times the average.) The table of sources is aggregated and
is the only thing ordered as a whole.

Defined cases: null text has size 0; a null source is a source of its own, ranked last;
null ids draw one common key and ties are ordered by size; an empty table gives no rows;
repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm._store import materialize, table, unused

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for nothing but digits and ASCII punctuation up to 4 for none of them; null and empty: 1."""
    kept = F.length(F.regexp_replace(text, r"[0-9!-/:-@\[-`{-~]+", ""))
    return F.when(F.length(text) > 0, 1.0 + 3.0 * kept / F.length(text)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_rows, source_size, target: weights go round the sources by code point, null last.

    All sizes are shared by weight; a target stops at ``max_epochs`` times its source and the
    excess is reshared. In the order of cap / weight the common level is the greatest of
    (what the capped ones before leave) / (the weight still open).
    """
    s = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level_here", left.cast("double") / open_weight)
    s = s.withColumn("level", F.max("level_here").over(every))
    return s.select("source", "source_rows", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _prefix(rows: DataFrame, value: str, order: list) -> DataFrame:
    """Add ``upto``: the sum of ``value`` over the source's rows up to this one, in ``order``; needs source_no and bucket."""
    buckets = rows.groupBy("source_no", "bucket").agg(F.sum(value).alias("in_bucket"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source_no", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(value).over(inside)).join(buckets, ["source_no", "bucket"]).withColumn("upto", F.col("upto") + F.col("before")).drop("before")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS, quality=quality_weight, keep: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the mix takes the document), taken (its words), and ``keep``."""
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), sampling_key(F.col("doc_id"), quality(text)).alias("key"), *keep)
    sized = materialize(sized, "sized")
    targets = source_targets(sized, weights, max_epochs)
    targets = targets.withColumn("source_no", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    n_buckets = F.ceil(F.col("source_rows") / bucket_rows)
    rows = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * n_buckets), n_buckets - 1).cast("long"))
    order = ["key", "doc_id", "size", *keep]
    first = _prefix(rows, "size", order).withColumn("drawn", F.col("upto") <= F.col("budget"))
    first = materialize(first.drop("upto", "source_rows"), "first")
    gap = first.where("drawn").groupBy("source_no").agg(F.sum("size").alias("got"))
    open_ = first.where("not drawn and size > 0").join(gap, "source_no", "left").withColumn("gap", F.col("budget") - F.coalesce("got", F.lit(0)))
    fill = _prefix(open_.where("size <= gap"), "size", order).withColumn("drawn", 2 * F.col("upto") - F.col("size") <= 2 * F.col("gap"))
    parts = (first.where("drawn or size = 0"), fill, open_.where("size > gap"))
    out = parts[0].unionByName(parts[1].select(*first.columns)).unionByName(parts[2].select(*first.columns))
    copies = F.col("epochs") + F.col("drawn").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows are told apart by a number written beside them, so repeated ones are drawn one by one."""
    names = docs.columns
    row, of, copies, again = (unused(names, n) for n in ("_row", "_of", "_copies", "_again"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, keep=[row], **how).where("copies > 0").select(F.col(row).alias(of), F.col("copies").alias(copies))
    both = numbered.join(taken, F.col(row) == F.col(of))
    return both.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*names)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         -ln((cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint) + 0.5::double) / 281474976710656::double)
         / case when length(text) > 0 then 1.0::double + 3.0::double * length(regexp_replace(text, '[0-9!-/:-@\[-`{-~]+', '', 'g')) / length(text)::double else 1.0::double end as key
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
r as (select *, row_number() over (order by source nulls last) as rank, source_size * 3 as cap from s),
w as (select *, (rank - 1) % 3 + 1 as weight from r),
l as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over f, 0) as double) / cast(sum(weight) over () - coalesce(sum(weight) over f, 0) as double) as level_here
      from w window f as (order by cap / weight::double, rank rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap::double, weight * max(level_here) over ()) as target from l),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
b as (select d.doc_id, d.source, d.size, d.key, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as budget,
             sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as upto
      from sized d join e on d.source is not distinct from e.source),
g as (select *, upto <= budget as drawn, budget - coalesce(sum(case when upto <= budget then size end) over (partition by source), 0) as gap from b),
f as (select *, sum(size) over (partition by source, (not drawn and size > 0 and size <= gap) order by key, doc_id, size rows unbounded preceding) as upto2 from g)
select doc_id, size, source_size, target,
       cast(size * (epochs + case when drawn or (size > 0 and size <= gap and 2 * upto2 - size <= 2 * gap) then 1 else 0 end) as bigint) as taken
from f
"""
