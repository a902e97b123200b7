"""Sharding by Karmarkar-Karp differencing, copies kept together.

Documents with equal text form a group (a null text has no bytes and joins the empty
ones). A group no larger than an even shard is indivisible; a larger one cannot be
balanced whole and is dealt by doc_id into parts of about a quarter shard. Groups are
hashed into blocks of bounded size; each block is differenced into one n-way partial
partition (the two partials of largest spread are combined, oppositely ordered, until
one is left), and the blocks' partials - ``n_shards`` numbers each - are differenced the
same way. Texts are never shuffled.

Defined cases: null text has size 16 and the checksum of no bytes; repeated rows and
null ids are placed like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm._store import discard, materialize, table

N_SHARDS = 40
OVERHEAD = 16
BLOCK_GROUPS = 8192
FAN_IN = 1024
SLOT_ROWS = 50_000


def difference(partials: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over rows of ``partials`` (n items x k slots): the final slot of every row's every slot."""
    n, k = partials.shape
    if not n:
        return np.zeros((0, k), np.int64)
    order = np.argsort(-partials, axis=1, kind="stable")
    sums = np.take_along_axis(partials, order, axis=1)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    held = {i: sums[i] for i in range(n)}
    # Slot j of a partial came from slot where[0][j] of its left part and where[1][j] of its right part.
    steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = held.pop(a) + held.pop(b)[::-1]
        by = np.argsort(-total, kind="stable")
        new = n + len(steps)
        steps.append((a, b, by, k - 1 - by))
        held[new] = total = total[by]
        heapq.heappush(heap, (-int(total[0] - total[-1]), new))
    place = {n + len(steps) - 1 if steps else 0: np.arange(k)}
    for i in range(len(steps) - 1, -1, -1):
        a, b, left, right = steps[i]
        at = place.pop(n + i)
        place[a], place[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        place[a][left] = at
        place[b][right] = at
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out


def karmarkar_karp(docs: DataFrame, n_shards: int = N_SHARDS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows_written = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")),
        "sizes",
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    even = max(1, (total or 0) // n_shards)
    parts = groups.where(F.col("bytes") > even).select("grp", F.ceil(4 * F.col("bytes") / even).cast("int").alias("parts"))
    # At most n_shards groups exceed an even shard, so this side is bounded by a constant.
    rows = rows.join(F.broadcast(parts), "grp", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    n_blocks = max(1, -(-(n or 0) // block_groups))
    pieces = rows.groupBy("grp", "part").agg(F.sum("size").alias("bytes")).withColumn("block", F.pmod(F.xxhash64("grp", "part"), F.lit(n_blocks)))

    def in_block(pdf):
        pdf = pdf.sort_values(["bytes", "grp", "part"], ascending=[False, True, True], ignore_index=True)
        start = np.zeros((len(pdf), n_shards), np.int64)
        start[:, 0] = pdf["bytes"]
        return pdf.assign(local=difference(start)[:, 0])

    local = local_written = materialize(pieces.groupBy("block").applyInPandas(in_block, "grp binary, part int, bytes long, block long, local int"), "local")

    def over_blocks(pdf):
        pdf = pdf.pivot_table(index="block", columns="local", values="bytes", aggfunc="sum").reindex(columns=range(n_shards)).fillna(0)
        final = difference(pdf.to_numpy(np.int64))
        return pd.DataFrame({"block": np.repeat(pdf.index.to_numpy(), n_shards), "local": np.tile(np.arange(n_shards), len(pdf)), "up": final.ravel()})

    while True:  # a tree over the blocks: a task sees FAN_IN partials at most
        sums = local.groupBy("block", "local").agg(F.sum("bytes").alias("bytes")).withColumn("parent", F.floor(F.col("block") / FAN_IN))
        up = sums.groupBy("parent").applyInPandas(over_blocks, "block long, local int, up int")
        local = local.join(up, ["block", "local"]).select("grp", "part", "bytes", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("up").alias("local"))
        n_blocks = -(-n_blocks // FAN_IN)
        if n_blocks == 1:
            break
    placed = materialize(rows.join(local.select("grp", "part", F.col("local").alias("shard")), ["grp", "part"]).select("doc_id", "size", "text_crc32", "shard"), "placed")
    discard(rows_written, local_written)
    return with_slots(placed, n or 0, n_shards)


def with_slots(placed: DataFrame, n: int, n_shards: int) -> DataFrame:
    """Number each shard's rows from 0 in two levels, so that no task sorts a whole shard."""
    n_buckets = max(1, -(-n // (n_shards * SLOT_ROWS)))
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("rn", F.row_number().over(inside)).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rn") - 1).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = karmarkar_karp(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
