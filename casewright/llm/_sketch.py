"""Fixed-size tables gathered from a whole corpus: hashed counters and bitmaps.

Every task folds its rows into one array, sends its non-empty blocks compressed, and the
blocks are summed per block id. What reaches the driver, and is broadcast from it, has the
same size whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

N_BLOCKS = 64


def pack_blocks(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    blocks = counts.reshape(N_BLOCKS, -1)
    used = np.flatnonzero(blocks.any(axis=1)).tolist()
    return used, [zlib.compress(blocks[i].tobytes(), 1) for i in used]


def sum_blocks(blocks: DataFrame, bits: int, dtype: str, join: np.ufunc = np.add) -> np.ndarray:
    """Sum (or another ``join``) of packed blocks (columns block int, counts binary) as one array of 2**bits."""
    size = (1 << bits) // N_BLOCKS

    def add(pdf):
        total = np.zeros(size, dtype)
        for raw in pdf["counts"]:
            join(total, np.frombuffer(zlib.decompress(raw), dtype), out=total)
        pdf = pdf.head(1).copy()
        pdf["counts"] = [zlib.compress(total.tobytes(), 1)]
        return pdf[["block", "counts"]]

    # Two levels, so a block's parts from very many tasks never meet in one.
    from pyspark.sql import functions as F

    dealt = blocks.select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part"))
    half = dealt.groupBy("block", "part").applyInPandas(add, "block int, counts binary")
    out = np.zeros((N_BLOCKS, size), dtype)
    for row in half.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype)
    return out.ravel()


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap of ``n`` ids: 16 places for each, 2**16 at least and 2**28 (32 MB) at most."""
    return min(28, max(16, (16 * n).bit_length()))


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Packed bitmap of the top ``bits`` bits of the one long column of ``ids``; ask it with ``in_bitmap``."""

    def run(batches):
        seen = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used, packed = pack_blocks(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    return sum_blocks(ids.mapInArrow(run, "block int, counts binary"), bits - 3, "uint8", np.bitwise_or)


def in_bitmap(held: np.ndarray, id_: int) -> bool:
    bits = len(held).bit_length() + 2
    at = (id_ & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
    return bool(held[at >> 3] >> (at & 7) & 1)
