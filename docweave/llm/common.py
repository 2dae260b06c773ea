"""Helpers shared by the operators: words, staged tables, size-checked joins, samples.

A word is a run of characters outside ``\\x20\\x09-\\x0D``.  On UTF-8 bytes that
is exactly ``bytes.split()``, and ``bytes.lower()`` folds exactly A-Z.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.plans.sizing import STAGED
from docweave.session import checkpoint_dir

WORD_GAP = r"[\x20\x09-\x0D]+"

# A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text, in order, as ARRAY<STRING>; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, evaluated once even where the body uses it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    return kept_at(df, label)[0]


def kept_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``staged``, and the path, which ``discard`` takes once nothing reads the table any more."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    STAGED.append(path)  # goes with ``docweave.plans.sizing.remove_staged``
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit ``BROADCAST_BYTES``, else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_small(left: DataFrame, right: DataFrame, on: list[str], row_bytes: int, salt: Column,
               salts: int = 32, how: str = "left") -> DataFrame:
    """Join ``left`` with the staged, one-row-per-key ``right`` without a hot key landing in one task.

    ``right`` is broadcast where its counted size allows.  Otherwise each of its
    rows is repeated once per salt and ``left`` is dealt by key and salt, so
    that a key with a third of all rows still spreads over ``salts`` tasks.
    Null keys match null keys.
    """
    rows = right.count()
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    if rows * row_bytes <= BROADCAST_BYTES:
        side, base = F.broadcast(right), left
    else:
        side = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        base = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
        keys.append(F.col("l._salt") == F.col("r._salt"))
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    joined = base.alias("l").join(side.alias("r"), cond, how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on]).drop("_salt")


def _prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it; keeps Arrow batches small.

    A batch of Spark's default of 10,000 rows may hold gigabytes of long texts;
    a session's own setting stays.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "2000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType,
                rows: int | None = None) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one record batch into the columns of ``schema``.

    ``rows`` hands batches over in slices of so many rows, which bounds what is made at a time.
    """
    _prepare(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                cols = fn(whole.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                     for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                   schema: T.StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns the record batches of a partition into those of ``schema``."""
    _prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct: whatever they are called, they cannot clash with names used beside it."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """The rows of ``df``, all columns, for which ``keep`` of their record batch is true."""
    _prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class TwoGenerations(dict):
    """Memo of ``make(key)`` bounded to about ``2 * size`` entries: the older half goes first.

    ``memo[key]`` runs ``make`` on a miss; keys longer than ``longest`` are not kept.
    """

    def __init__(self, make: Callable, size: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def bounded_sample(df: DataFrame, stratum: str, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of each stratum: those with the smallest ``key`` hashes.

    ``key`` is a uniform 64-bit hash.  Strata are counted first and only keys in
    the lowest part that holds about ``2 * rows`` of them are ranked, so the
    ranking task of a stratum reads a bounded number of keys at any size; full
    rows move only once chosen.  Repeated rows share a key and count once.
    """
    keyed = df.withColumn("_key", key)
    keys = keyed.select(stratum, "_key").distinct()
    totals = staged(keys.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")), "sample-strata")
    place = (F.col("_key").cast("double") + 2.0 ** 63) / 2.0 ** 64
    low = keys.join(sized(totals, 64), stratum).filter(place * F.col("_n") <= 2.0 * rows + 100)
    ranked = (low.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_key")))
              .filter(F.col("_rank") <= rows).select(stratum, "_key"))
    chosen = staged(ranked, "sample-keys")
    picked = keyed.join(sized(chosen, 64), [stratum, "_key"], "left_semi")
    firsts = [F.first(c).alias(c) for c in df.columns if c != stratum]
    return picked.groupBy(stratum, "_key").agg(*firsts).drop("_key")
