"""Embeddings as unit vectors in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part() -> Column:
    """Whether the row's ``embedding`` is not null, holds no null or non-finite component and is not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def doubles(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) in double precision."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled by the largest component first, so no square over- or underflows."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def named(good: DataFrame) -> DataFrame:
    """(vec_id, name, dim, raw): the vector's bytes as doubles and their 128-bit digest; 0.0 and -0.0 are one number."""

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            raws = [v.tobytes() for v in np.split(values, ends[:-1])] if len(ends) else []
            names = [hashlib.blake2b(r, digest_size=16).digest() for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array([len(r) // 8 for r in raws], pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "name", "dim", "raw"])

    return good.select("vec_id", "embedding").mapInArrow(run, "vec_id long, name binary, dim int, raw binary")


def matrix(raws: list[bytes]) -> np.ndarray:
    """Vectors of one length, from their bytes, as unit rows."""
    return unit(np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1))
