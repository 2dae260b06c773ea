"""Two-level (chunked) numbering for groups of any size.

``row_number().over(partitionBy(key))`` sends a whole group to one task.  Here
the rows are range-partitioned by key and all order columns, whose borders Spark
samples: a chunk is one partition, a key's rows lie in consecutive chunks, and
a group holding a third of all rows is cut wherever its order columns allow,
which are unique together.  Each chunk is numbered on its own, and the chunks'
offsets come from a running sum over the small per-chunk count table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.plans.sizing import NAME_BYTES, materialize, maybe_broadcast

CHUNK_ROWS = 1 << 12
# More chunks than this would cost more in scheduling than they spread.
MOST_CHUNKS = 20_000


def chunked(df: DataFrame, keys: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df``, stored, with ``_chunk``: partitions of about ``chunk_rows`` rows in the order of ``keys`` and ``order``."""
    rows = materialize(df, "scan-rows")
    chunks = min(MOST_CHUNKS, max(1, -(-rows.count() // chunk_rows)))
    if chunks == 1:
        return rows.withColumn("_chunk", F.lit(0))
    ranged = rows.repartitionByRange(chunks, *keys, *order)
    return materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "scan-chunks")


def _with_offsets(df: DataFrame, keys: list[str], value) -> DataFrame:
    """Chunked ``df`` with ``_offset``: the total of ``value`` over the earlier chunks of the same key."""
    totals = materialize(df.groupBy(*keys, "_chunk").agg(value.alias("_t")), "scan-totals")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    # Keys that lie in one chunk need no offset: what comes back is small unless most keys are large.
    later = materialize(offsets.filter(F.col("_offset") != 0), "scan-offsets")
    side = maybe_broadcast(later, later.count(), NAME_BYTES).alias("o")
    met = [F.col(f"d.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "_chunk")]
    cond = met[0]
    for m in met[1:]:
        cond = cond & m
    return df.alias("d").join(side, cond, "left").select(
        "d.*", F.coalesce(F.col("o._offset"), F.lit(0)).alias("_offset"))


def dense_positions(df: DataFrame, key: str, order: str, out: str = "pos",
                    chunk_rows: int = CHUNK_ROWS, extra_order: list[str] | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank by (``order``, *``extra_order``) within ``key``.

    The ordering columns must be unique per key.
    """
    ordering = [order, *(extra_order or [])]
    parts = chunked(df, [key], ordering, chunk_rows)
    local = Window.partitionBy(key, "_chunk").orderBy(*ordering)
    return (_with_offsets(parts, [key], F.count(F.lit(1)))
            .withColumn(out, (F.col("_offset") + F.row_number().over(local) - 1).cast("bigint"))
            .drop("_chunk", "_offset"))


def running_total(df: DataFrame, keys: list[str], order: str, value, out: str,
                  chunk_rows: int = CHUNK_ROWS, keep_chunk: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows *before* each row of its group.

    Same result as ``sum(value).over(partitionBy(keys).orderBy(order)
    .rowsBetween(unboundedPreceding, -1))`` (0 for the first row), computed as
    chunk totals + offsets + a per-chunk window, so no task holds a whole group.
    ``order`` is unique per group.  ``keep_chunk`` leaves ``_chunk``, which grows
    with the order inside a group.
    """
    parts = chunked(df.withColumn("_v", value), keys, [order], chunk_rows)
    local = (Window.partitionBy(*keys, "_chunk").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
    done = _with_offsets(parts, keys, F.sum("_v")).withColumn(
        out, F.col("_offset") + F.coalesce(F.sum("_v").over(local), F.lit(0)))
    return done.drop("_v", "_offset") if keep_chunk else done.drop("_v", "_offset", "_chunk")
