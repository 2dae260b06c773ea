"""Broadcast guards and lineage cuts.

A side is broadcast only when an upper bound on its size is known and under
the limit.  Bounds come from a row bound the caller can prove (usually a count
of the source table the side derives from, which Parquet answers from footers)
times a per-row byte estimate.  Above the limit the join stays a shuffle join
and AQE (skew-join splitting, runtime broadcast conversion) takes over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.constants import BROADCAST_LIMIT_BYTES
from docweave.session import checkpoint_dir, is_local

# Paths of the tables that this process has stored under the checkpoint folder.
STAGED: list[str] = []

# Bytes of a row that holds a 32-character fingerprint and a few keys.
NAME_BYTES = 96


def fits(row_bound: int | None, bytes_per_row: int, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return row_bound is not None and row_bound * bytes_per_row <= limit


def maybe_broadcast(df: DataFrame, row_bound: int | None, bytes_per_row: int,
                    limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``F.broadcast(df)`` when ``row_bound * bytes_per_row <= limit``, else ``df``."""
    return F.broadcast(df) if fits(row_bound, bytes_per_row, limit) else df


def vector_row_bytes(dim: int, extra: int = NAME_BYTES) -> int:
    """Bytes per row of a table holding one vector (of doubles at most) plus a few keys."""
    return 8 * dim + extra


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cores of a local session when it has fewer splits.

    A test table stored as one Parquet row group is read by one task; the
    row-wise text work that follows would then run on one core.  On a cluster
    nothing is moved: ``spark.sql.files.maxPartitionBytes`` sets the splits.
    """
    if not is_local(df.sparkSession):
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used where a pipeline scans the same derived table several times: the
    re-reads are column-pruned Parquet scans instead of recomputations, and
    the stored copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remove_staged(spark: SparkSession) -> int:
    """Removes the tables that this process has stored so far; their number.

    For a caller that has written or shown a result: DataFrames that were made
    before and still read such a table cannot be used afterwards.
    """
    removed = 0
    while STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed
