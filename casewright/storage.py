"""Intermediate tables in the folder all executors share.

A written table cuts lineage like ``checkpoint()`` does and survives the loss of
any executor, but stays columnar and compressed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the directory given to ``setCheckpointDir``.

    Where neither is set, a temporary folder in local mode; elsewhere an error, because the
    executors would write to folders of their own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="casewright-"))
    sc.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._casewright_path = path
    _written.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_casewright_path", None):
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table this process still keeps; for use once the results that read them are written."""
    for path in list(_written):
        _delete(spark, path)


#: Bytes up to which Spark's estimate lets a side be broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if Spark's estimate of its size is within ``limit``; else as it is, joined by shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; an input with more stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)
