"""Near-duplicate narratives: MinHash signatures, banding, components, cluster summaries, cohesion.

Two texts with an equal band are linked, verified or not (``verify``). Equal texts are one
node. A band's members are linked to the smallest of them - a star, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import normalize, redaction_ratio
from casewright.operators.components import components
from casewright.operators.joins import first_k
from casewright.storage import materialize


def bands_for(threshold: float, perms: int) -> tuple[int, int]:
    """(bands, rows) whose inflection (1/b)^(1/r) is closest to the threshold."""
    return min(((perms // r, r) for r in range(1, perms + 1)), key=lambda br: abs((1 / br[0]) ** (1 / br[1]) - threshold))


#: Shingles hashed against all permutations at a time; bounds a worker's memory on very long texts.
_CHUNK = 8192
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(normalized: str, k: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word k-grams of a normalised text; the whole text under k words; none for an empty one."""
    words = normalized.encode().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = min(len(words), k)
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - m + 1, np.uint64)
        for i in range(m):
            h = (h + w[i : len(w) - m + 1 + i]) * _ODD
            h ^= h >> np.uint64(29)
    return np.unique(h)


def permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the hash permutations; the same in every run."""
    rng = np.random.default_rng(1)
    return rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, perms, dtype=np.uint64)


def signature(grams: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minimum of every permutation over the shingle hashes."""
    low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), _CHUNK):
            h = grams[None, at : at + _CHUNK] * factor[:, None] + shift[:, None]
            h ^= h >> np.uint64(32)
            np.minimum(low, (h * _ODD).min(axis=1), out=low)
    return low


SIGNED = "complaint_id long, norm string, hash binary, keys array<long>"


def signed(c: DataFrame, threshold: float, perms: int, k: int, min_tokens: int, max_redaction: float) -> DataFrame:
    """Cases with a narrative long enough and not mostly redacted: normalised text, its SHA-1, one 64-bit key for each band of its MinHash signature.

    Eligibility, shingling, hashing and signing are numpy over one Arrow pass, so the text
    is normalised once; a text that a task has just seen is not signed again.
    """
    bands, rows = bands_for(threshold, perms)
    factor, shift = permutations(perms)

    def run(batches):
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                norm = batch.column(1)[i].as_py()
                if batch.column(2)[i].as_py() > max_redaction or not norm or norm.count(" ") + 1 < min_tokens:
                    continue
                name = hashlib.sha1(norm.encode()).digest()
                keys = known.get(name)
                if keys is None:
                    low = signature(shingle_hashes(norm, k), factor, shift)
                    keys = [int.from_bytes(hashlib.blake2b(low[b * rows : (b + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True) for b in range(bands)]
                    if len(known) >= 100_000:
                        known.clear()
                    known[name] = keys
                for column, value in zip(out, (batch.column(0)[i].as_py(), norm, name, keys)):
                    column.append(value)
            kinds = pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, kind) for o, kind in zip(out, kinds)], names=["complaint_id", "norm", "hash", "keys"])

    told = c.where("has_narrative = 1")
    return told.select("complaint_id", normalize(F.col("narrative")).alias("norm"), redaction_ratio(F.col("narrative")).alias("ratio")).mapInArrow(run, SIGNED)


def _verified(edges: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The edges (src, dst) whose texts reach the threshold exactly."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingle_hashes(x.as_py(), k), shingle_hashes(y.as_py(), k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    side = lambda n: texts.select(F.col("node").alias(n), F.col("norm").alias(f"t_{n}"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "t_src", "t_dst").mapInArrow(run, "src long, dst long")


def near_duplicate_clusters(c: DataFrame, threshold: float = 0.8, perms: int = 64, k: int = 5, min_tokens: int = 25, max_redaction: float = 0.5, max_group: int | None = None, verify: bool = False) -> DataFrame:
    """(complaint_id, cluster, norm) of the members of clusters of two cases or more; cluster is the smallest id.

    A band's members are linked to one hub, so its size costs nothing and none is left out.
    ``max_group``: bands shared by more distinct texts than this are ignored; ``band_sizes`` shows which.
    """
    rows = materialize(signed(c, threshold, perms, k, min_tokens, max_redaction), "signed")
    texts = rows.groupBy("hash").agg(F.min("complaint_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    texts = materialize(texts, "texts")
    banded = texts.select("node", F.posexplode("keys").alias("band", "key"))
    hubs = band_sizes(banded).where(F.col("n") > 1)
    if max_group is not None:
        hubs = hubs.where(F.col("n") <= max_group)
    edges = banded.join(hubs, ["band", "key"]).where("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()
    if verify:
        edges = _verified(edges, rows.join(texts.select("hash", "node"), "hash").where("complaint_id = node"), k, threshold)
    parts = components(edges)
    cluster = texts.join(parts.withColumnRenamed("id", "node"), "node", "left").where("copies > 1 or component is not null")
    return rows.join(cluster.select("hash", F.coalesce("component", "node").alias("cluster")), "hash").select("complaint_id", "cluster", "norm")


def band_sizes(banded: DataFrame) -> DataFrame:
    """(band, key, hub, n): the smallest node and the number of distinct texts of each band key."""
    return banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"))


def cluster_summary(members: DataFrame, c: DataFrame, ids: int = 100, chars: int = 600) -> DataFrame:
    """Size, firms and states (blank ones left out; counts and sorted lists), segments, dates, mean redaction ratio, exemplar and first ids of each cluster.

    The exemplar is the normalised text of the smallest id, up to ``chars`` characters.
    """
    facts = c.select("complaint_id", "company", "state", "segment", "date_received", redaction_ratio(F.col("narrative")).alias("ratio"))
    rows = members.select("complaint_id", "cluster", F.when(F.col("complaint_id") == F.col("cluster"), F.substring("norm", 1, chars)).alias("shown")).join(facts, "complaint_id")
    blank = lambda col: F.when(F.col(col) != "", F.col(col))
    out = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct(blank("company")).alias("companies"), F.count_distinct(blank("state")).alias("states"),
        F.array_sort(F.collect_set(blank("company"))).alias("company_list"), F.array_sort(F.collect_set(blank("state"))).alias("state_list"), F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"),
        F.min("date_received").alias("first_date"), F.max("date_received").alias("last_date"), F.avg("ratio").alias("mean_redaction_ratio"), F.max("shown").alias("exemplar"),
    )
    listed = first_k(rows.select("cluster", "complaint_id"), ["cluster"], ["complaint_id"], ids).groupBy("cluster").agg(F.array_sort(F.collect_list("complaint_id")).alias("complaint_ids"))
    return out.withColumn("day_span", F.datediff("last_date", "first_date")).join(listed, "cluster")


def cohesion(members: DataFrame, threshold: float = 0.8, k: int = 5, min_size: int = 10, sample: int = 40) -> DataFrame:
    """Mean similarity of the first ``sample`` members to the cluster's smallest id, and the share at the threshold or above."""

    def run(batches):
        for batch in batches:
            sims = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingle_hashes(x.as_py(), k), shingle_hashes(y.as_py(), k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["cluster", "size", "s"])

    big = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    ids = materialize(first_k(members.select("cluster", "complaint_id").join(big, "cluster"), ["cluster"], ["complaint_id"], sample), "sampled")
    some = members.select("complaint_id", "norm").join(ids, "complaint_id")
    anchor = members.where(F.col("complaint_id") == F.col("cluster")).join(big, "cluster", "left_semi").select("cluster", F.col("norm").alias("anchor"))
    pairs = some.where(F.col("complaint_id") != F.col("cluster")).join(anchor, "cluster").select("cluster", "size", "norm", "anchor")
    sims = pairs.mapInArrow(run, "cluster long, size long, s double")
    return sims.groupBy("cluster").agg(F.first("size").alias("size"), F.avg("s").alias("mean_similarity"), (100 * F.count_if(F.col("s") >= threshold) / F.count(F.lit(1))).alias("cohesion_pct"), F.count(F.lit(1)).alias("sampled"))


SIZE_BANDS = ((2, 3, "2"), (3, 10, "3-9"), (10, 50, "10-49"), (50, 500, "50-499"), (500, 5000, "500-4999"), (5000, None, "5000+"))
COHESION_BANDS = ((80, "tight"), (50, "moderate"), (20, "loose"), (0, "chained"))


def size_bands(sizes: DataFrame, column: str = "size") -> DataFrame:
    """(band, clusters, complaints) of group sizes; empty bands are absent."""
    band = F.lit(None).cast("string")
    for low, high, label in SIZE_BANDS:
        hit = F.col(column) >= low if high is None else (F.col(column) >= low) & (F.col(column) < high)
        band = F.when(hit, label).otherwise(band)
    return sizes.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("clusters"), F.sum(column).alias("complaints"))


def cohesion_bands(found: DataFrame) -> DataFrame:
    band = None
    for low, label in COHESION_BANDS:
        band = F.when(F.col("cohesion_pct") >= low, label) if band is None else band.when(F.col("cohesion_pct") >= low, label)
    return found.withColumn("band", band).groupBy("band").agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("complaints"))


def cluster_row(summary: DataFrame, found: DataFrame, chars: int = 300) -> DataFrame:
    """Flat, printable form of cluster summaries with their ``cohesion`` (null where not measured): the first 4 segments, 3 firms and 20 ids as text."""
    measured = found.select("cluster", F.round("mean_similarity", 3).alias("cohesion_mean"), F.round("cohesion_pct", 1).alias("cohesion_pct"), F.col("sampled").alias("cohesion_sampled"))
    rows = summary.join(measured, "cluster", "left").withColumn("cohesion_sampled", F.coalesce("cohesion_sampled", F.lit(0)))
    first = F.array_join(F.slice(F.split("segments", ","), 1, 4), ",").alias("segments")
    return rows.select("cluster", "size", "cohesion_mean", "cohesion_pct", "cohesion_sampled", "companies", "states", first, "first_date", "last_date", "day_span", F.round("mean_redaction_ratio", 3).alias("mean_redaction_ratio"),
        F.array_join(F.slice("company_list", 1, 3), " | ").alias("top_companies"), F.substring("exemplar", 1, chars).alias("exemplar"), F.array_join(F.transform(F.slice("complaint_ids", 1, 20), lambda x: x.cast("string")), ", ").alias("ids"),
    )
