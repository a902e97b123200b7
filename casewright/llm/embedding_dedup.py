"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class, named by a 128-bit digest, so copies cost nothing. The classes
are cut into blocks of bounded size, each written as one row: int8 codes, a scale and two
bounds per vector. A task takes one pair of blocks. With x = s q + e (q int8, s the vector's
scale, |e| known), Cauchy-Schwarz gives
|x.y - s_x s_y q_x.q_y| <= |e_x| |ŷ| + |x̂| |e_y| + |e_x| |e_y|, so a pair is a link for
certain, none for certain, or open. Only open pairs are recomputed in double precision: the
vectors that stand in a tile's open pairs are fetched for it, once each. Both passes return
link counts per vector and a spanning forest of their links, never all pairs.

The comparison is complete, so its work grows with the square of the number of distinct
vectors; memory and shuffle per task stay bounded by the block size.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing and are their own component, kept; vectors of different length do not link; equal
vectors link with each other (0.0 and -0.0 are equal); null ids are ignored for component ids;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._store import discard, hot_join, materialize, table
from casewright.llm._vectors import doubles, matrix, named, takes_part
from casewright.llm.graph import connected_components, forest

THRESHOLD = 0.9
BLOCK = 2048
_SLACK = 1e-12
#: What a certain link must exceed the threshold by, far above the rounding of a product in double precision.
_SURE = 1e-9
#: Open pairs handed on in one piece: 16 MB, and as many vectors at most as two blocks hold.
OPEN_PAIRS = 1 << 20
PACKED = ("ids", "sizes", "codes", "scales", "lengths", "errors")
Quantised = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def quantise(x: np.ndarray) -> Quantised:
    """int8 codes, scales, lengths of the decoded vectors and of their errors (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1) * (1 + _SLACK), np.linalg.norm(x - decoded, axis=1) * (1 + _SLACK) + _SLACK


def tile_pairs(x: Quantised, y: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) whose cosine may reach the threshold, and whether it does so for certain."""
    (qx, sx, lx, ex), (qy, sy, ly, ey) = x, y
    # Products of int8 codes are integers below 2**24 for up to 1040 components, exact in float32.
    kind = np.float32 if qx.shape[1] <= 1040 else np.float64
    dots = qx.astype(kind) @ qy.astype(kind).T
    # s_x s_y d + e_x l_y + l_x e_y + e_x e_y >= t, in double, only where a float32 pre-test with one bound per row may pass
    least = threshold - ex * ly.max() - (lx + ex) * ey.max() - 1e-5
    least = np.where(least > 0, least / (sx * sy.max()), -np.inf)
    i, j = np.nonzero(dots >= least.astype(kind)[:, None])
    value = sx[i] * sy[j] * dots[i, j].astype(np.float64)
    error = ex[i] * ly[j] + lx[i] * ey[j] + ex[i] * ey[j] + _SLACK
    near = value + error >= threshold
    i, j, value, error = i[near], j[near], value[near], error[near]
    return i, j, value - error >= threshold + _SURE


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of unit rows with x_i . y_j >= threshold in double precision, by way of their codes."""
    i, j, sure = tile_pairs(quantise(x), quantise(y), threshold)
    good = sure | exact_links(x[i], y[j], threshold)
    return i[good], j[good]


def exact_links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of ``x`` with the same row of ``y``, unit vectors, reaches the threshold in double precision."""
    return np.einsum("ij,ij->i", x, y) >= threshold


def _blocks(classes: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block: its class ids, class sizes, int8 codes, scales, lengths and error bounds."""
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(n_blocks)).cast("int"))

    def pack(key, t):
        units = matrix(t["raw"].to_pylist())
        ids, sizes = t["cid"].to_numpy().astype(np.int64), t["rows"].to_numpy().astype(np.int64)
        cols = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([a.tobytes()], pa.binary()) for a in (ids, sizes, *quantise(units))]
        return pa.table(cols, names=["dim", "block", *PACKED])

    return dealt.select("dim", "block", "cid", "rows", "raw").groupBy("dim", "block").applyInArrow(pack, "dim int, block int, " + ", ".join(f"{c} binary" for c in PACKED))


def _summary(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> list[pa.Array]:
    """Columns a, b, links of the links (a, b): what every vector gains (b null) and the edges of a spanning forest."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    gain = np.bincount(at, np.concatenate([size_b, size_a]), len(ends)).astype(np.int64)
    x, y = forest(a, b)
    none = lambda n: pa.nulls(n, pa.int64())
    return [pa.array(np.concatenate([ends, x]).astype(np.int64)), pa.concat_arrays([none(len(ends)), pa.array(y, pa.int64())]), pa.concat_arrays([pa.array(gain), none(len(x))])]


def _tiles(blocks: DataFrame, n_blocks: int, threshold: float) -> DataFrame:
    """What the codes decide: rows (a, b, links) of certain links, and rows with the ``open`` pairs of class ids, 16 bytes each."""

    def packed(row: dict, k: str) -> tuple:
        read = lambda name, kind: np.frombuffer(row[f"{name}{k}"], kind)
        ids = read("ids", np.int64)
        return ids, read("sizes", np.int64), (read("codes", np.int8).reshape(len(ids), -1), *(read(n, np.float64) for n in PACKED[3:]))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                (ids, sizes, x), (ids2, sizes2, y) = packed(row, "1"), packed(row, "2")
                i, j, sure = tile_pairs(x, y, threshold)
                if row["block1"] == row["block2"]:
                    upper = i < j
                    i, j, sure = i[upper], j[upper], sure[upper]
                columns = _summary(ids[i[sure]], ids2[j[sure]], sizes[i[sure]], sizes2[j[sure]])
                pairs = np.column_stack([ids[i[~sure]], ids2[j[~sure]]])
                parts = [pairs[k : k + OPEN_PAIRS].tobytes() for k in range(0, len(pairs), OPEN_PAIRS)]
                none = lambda n: pa.nulls(n, pa.int64())
                columns = [pa.concat_arrays([c, none(len(parts))]) for c in columns] + [pa.concat_arrays([pa.nulls(len(columns[0]), pa.binary()), pa.array(parts, pa.binary())])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "links", "open"])

    side = lambda k: blocks.select("dim", *[F.col(c).alias(f"{c}{k}") for c in ("block", *PACKED)])
    left = side("1").withColumn("block2", F.explode(F.sequence(F.col("block1"), F.lit(n_blocks - 1))))
    # Tiles are dealt one by one; only the two blocks of a tile meet.
    tiles = left.join(side("2").hint("shuffle_hash"), ["dim", "block2"])
    return tiles.mapInArrow(run, "a long, b long, links long, open binary")


def _decide(tiles: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, links) of the open pairs that link: each part of a tile fetches the vectors it needs, once each."""
    parts = tiles.where("open is not null").select(F.xxhash64("open").alias("part"), "open")

    def needs(batches):
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.unique(np.frombuffer(raw, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), pa.array(ids)], names=["part", "cid"])

    def decide(left, right):
        ids, sizes = left["cid"].to_numpy(), left["rows"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, sizes, raws = ids[order], sizes[order], left["raw"].to_pylist()
        units = matrix([raws[k] for k in order]) if len(order) else np.empty((0, 1))
        pairs = np.concatenate([np.frombuffer(raw, np.int64) for raw in right["open"].to_pylist()] or [np.empty(0, np.int64)]).reshape(-1, 2)
        i, j = np.searchsorted(ids, pairs[:, 0]), np.searchsorted(ids, pairs[:, 1])
        good = np.concatenate([exact_links(units[i[k : k + 65536]], units[j[k : k + 65536]], threshold) for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
        i, j = i[good], j[good]
        return pa.table(_summary(ids[i], ids[j], sizes[i], sizes[j]), names=["a", "b", "links"])

    wanted = parts.mapInArrow(needs, "part long, cid long").join(classes.select("cid", "rows", "raw"), "cid")
    return wanted.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(decide, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    every = doubles(vectors)
    good = materialize(named(every.where(takes_part())), "vectors")
    classes = good.groupBy("name").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    n_blocks = max(1, math.ceil(n / block))
    blocks = materialize(_blocks(classes, n_blocks), "blocks")
    tiles = materialize(_tiles(blocks, n_blocks, threshold), "tiles")
    discard(blocks)
    found = materialize(tiles.where("open is null").select("a", "b", "links").unionByName(_decide(tiles, classes, threshold)), "links")
    discard(tiles)
    parts = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    sizes = classes.select("name", "cid", "rows", "least")
    known = sizes.join(links, sizes["cid"] == links["a"], "left").join(parts, sizes["cid"] == parts["id"], "left")
    known = known.select("name", "cid", "rows", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    known = materialize(known, "known")
    heads = known.where("component is not null").groupBy("component").agg(F.min("least").alias("head"))
    # A component's head reaches its members, and a class its rows, over salted keys: either may be a third of the table.
    linked = hot_join(known.where("component is not null"), heads, "component", "cid", F.lit(None).cast("long")).select("name", "rows", "least", "n_links", F.col("head").alias("component_id"))
    alone = known.where("component is null").select("name", "rows", "least", "n_links", F.col("least").alias("component_id"))
    facts = linked.unionByName(alone)
    linked = hot_join(good.select("vec_id", "name"), facts, "name", "vec_id", F.when(F.col("rows") == 1, F.col("least"))).select("vec_id", "n_links", "component_id")
    rest = every.where(~takes_part()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
