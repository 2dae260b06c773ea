"""The fragment index: one Parquet table partitioned by a hash shard of ``name``.

Layout: ``name, pos, text, embedding, shard``; batch writes, the stream, clear
and reindex all use it.  The number of shards and the schema are stored beside
the table (``<path>_layout``) when it is created, so readers and writers cannot
disagree and an index without rows can be read.
Reading a few names prunes to their shards; files are sorted by (name, pos) and
carry a bloom filter on ``name``, so few row groups of a shard are opened.

Writing continues the positions of names that are already stored; an append
with a ``write_id`` can be repeated after any failure and adds its rows once.
Every other change is staged whole, announced in ``<path>_pending`` and then
applied: whoever opens the index next finishes a change that was cut off, so
rows and layout always fit together.  Shards left empty are removed.  The
names of an index are the names of its rows: a cleared document is unknown at
once and can come back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.plans.scan import dense_positions
from docweave.session import checkpoint_dir

DEFAULT_SHARDS = 64

# Files of the index say which names they may hold.
NAME_BLOOM = {"parquet.bloom.filter.enabled#name": "true", "parquet.bloom.filter.max.bytes": str(1 << 16)}


def file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists; a storage error is raised, not taken for absence."""
    fs, jpath = file_system(spark, path)
    return bool(fs.exists(jpath))


def layout_path(path: str) -> str:
    return path.rstrip("/") + "_layout"


def pending_path(path: str) -> str:
    return path.rstrip("/") + "_pending"


def writes_path(path: str) -> str:
    return path.rstrip("/") + "_writes"


def _delete(spark: SparkSession, path: str) -> None:
    fs, jpath = file_system(spark, path)
    fs.delete(jpath, True)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all (written beside, then renamed)."""
    fs, target = file_system(spark, path)
    _, part = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(part, target):
        fs.delete(part, True)
        if not fs.exists(target):
            raise OSError(f"cannot write {path}")


def small_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    if not path_exists(spark, path):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def index_exists(spark: SparkSession, path: str) -> bool:
    finish_pending(spark, path)
    return path_exists(spark, layout_path(path))


def _write_layout(spark: SparkSession, path: str, shards: int, schema: str) -> None:
    (spark.createDataFrame([(shards, schema)], "shards int, schema string").coalesce(1)
     .write.mode("overwrite").parquet(layout_path(path)))


def finish_pending(spark: SparkSession, path: str) -> None:
    """Applies a change that was announced but not finished; nothing to do otherwise.

    Every step can be repeated: the staged rows of the touched shards replace
    what is stored, shards without rows go, the layout is written, and only then
    the announcement and the staged copy are removed.
    """
    told = small_file(spark, pending_path(path))
    if told is None:
        return
    change = json.loads(told)
    rows = spark.read.schema(T.StructType.fromJson(json.loads(change["schema"]))).parquet(change["stage"])
    mode = "static" if change["shards"] is None else "dynamic"
    (_for_write(rows).write.mode("overwrite").options(partitionOverwriteMode=mode, **NAME_BLOOM)
     .partitionBy("shard").parquet(path))
    if change["shards"] is not None:
        kept = {r["shard"] for r in rows.select("shard").distinct().collect()}  # at most the layout's shards
        for shard in set(change["shards"]) - kept:
            _delete(spark, f"{path.rstrip('/')}/shard={shard}")
    _write_layout(spark, path, change["count"], change["schema"])
    _delete(spark, pending_path(path))
    _delete(spark, change["stage"])


def _change(spark: SparkSession, path: str, rows: DataFrame, shards: list[int] | None, count: int) -> None:
    """Replaces the rows of ``shards`` (all for None) by ``rows``, which have a ``shard``, in an index of ``count`` shards."""
    stage = f"{checkpoint_dir(spark).rstrip('/')}/index-stage-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").parquet(stage)
    _put(spark, pending_path(path), json.dumps(
        {"stage": stage, "shards": shards, "count": count, "schema": rows.schema.json()}))
    finish_pending(spark, path)


def stored_shards(spark: SparkSession, path: str) -> int:
    """Number of shards the index was created with."""
    return spark.read.parquet(layout_path(path)).select("shards").first()[0]


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the index (``shard`` is the last column)."""
    finish_pending(spark, path)
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(layout_path(path)).select("schema").first()[0]))
    return spark.read.schema(schema).parquet(path)


def open_index(spark: SparkSession, path: str, schema: T.StructType, shards: int | None = None) -> int:
    """Shard count of the index, created for rows of ``schema`` in ``shards`` if there is none yet."""
    if index_exists(spark, path):
        stored = stored_shards(spark, path)
        if shards is not None and shards != stored:
            raise ValueError(f"the index at {path} has {stored} shards, not {shards}")
        return stored
    count = shards or DEFAULT_SHARDS
    fields = [f for f in schema.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())]
    fs, jpath = file_system(spark, path)
    fs.mkdirs(jpath)
    _write_layout(spark, path, count, T.StructType(fields).json())
    return count


def shard_of(name: Column, shards: int = DEFAULT_SHARDS) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(shards)).cast("int")


def with_shard(df: DataFrame, shards: int = DEFAULT_SHARDS) -> DataFrame:
    return df.withColumn("shard", shard_of(F.col("name"), shards))


def _for_write(df: DataFrame) -> DataFrame:
    """Rows gathered by shard, in files of the advisory size: AQE splits a large shard and joins small ones."""
    return df.hint("rebalance", "shard").sortWithinPartitions("shard", "name", "pos")


def write_index(df: DataFrame, path: str, shards: int | None = None, mode: str = "append",
                write_id: str | None = None) -> None:
    """S4 (storage). Append rows (name, pos, text, embedding), or overwrite the index with them.

    Appended rows of a name that is stored already are numbered after its
    stored ones, in the order of their ``pos``.  ``shards`` counts when the index is
    created; later it may be left out, and a different value raises, but an
    overwrite may choose anew.  An append with a ``write_id`` that was finished
    does nothing, and one that was cut off adds what is missing: its rows are
    staged with their final positions before the first is stored.
    """
    spark = df.sparkSession
    if mode == "overwrite":
        count = shards or DEFAULT_SHARDS
        finish_pending(spark, path)
        _change(spark, path, with_shard(df.drop("shard"), count), None, count)
        return
    count = open_index(spark, path, df.schema, shards)
    done = f"{writes_path(path)}/{write_id}.done"
    if write_id is not None and path_exists(spark, done):
        return
    columns = stored_rows(spark, path).columns
    staged = f"{writes_path(path)}/{write_id}.rows"
    if write_id is not None and path_exists(spark, f"{staged}/_SUCCESS"):
        rows = spark.read.schema(stored_rows(spark, path).schema).parquet(staged)
        seen = stored_rows(spark, path).select("shard", "name", "pos").join(
            rows.select("shard", "name").distinct(), ["shard", "name"], "left_semi")
        rows = rows.join(seen, ["shard", "name", "pos"], "left_anti").select(*columns)
    else:
        rows = with_shard(df, count)
        starts = (stored_rows(spark, path).join(rows.select("shard", "name").distinct(), ["shard", "name"], "left_semi")
                  .groupBy("name").agg((F.max("pos") + 1).alias("_start")))
        rows = (rows.join(starts, "name", "left")
                .withColumn("pos", F.col("pos") + F.coalesce("_start", F.lit(0))).drop("_start"))
        if write_id is not None:
            rows.select(*columns).write.mode("overwrite").parquet(staged)
            rows = spark.read.schema(stored_rows(spark, path).schema).parquet(staged)
    _for_write(rows).write.mode("append").options(**NAME_BLOOM).partitionBy("shard").parquet(path)
    if write_id is not None:
        _put(spark, done, "")
        _delete(spark, staged)


def read_index(spark: SparkSession, path: str, names=None) -> DataFrame:
    """S5. The index, or only ``names`` (a list of values or a DataFrame with ``name``)."""
    index = stored_rows(spark, path)
    if names is None:
        return index
    shards = stored_shards(spark, path)
    if isinstance(names, DataFrame):
        wanted = names.select("name").distinct().withColumn("shard", shard_of(F.col("name"), shards))
        return index.join(wanted, ["shard", "name"], "left_semi")
    # Hash the literal as the stored type so it lands on the same shard.
    name_type = index.schema["name"].dataType
    wanted_shards = [shard_of(F.lit(n).cast(name_type), shards) for n in names]
    return index.filter(F.col("shard").isin(wanted_shards) & F.col("name").isin(list(names)))


def stored_names(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Those of ``names`` that the index holds.

    Only the names' shards are read, and of them the first fragment of each
    document (``pos`` 0, a pushed-down filter) and two columns.
    """
    wanted = names.select("name").distinct().withColumn("shard", shard_of(F.col("name"), stored_shards(spark, path)))
    firsts = stored_rows(spark, path).filter(F.col("pos") == 0).select("shard", "name")
    return wanted.join(firsts, ["shard", "name"], "left_semi").select("name")


def append_positions(existing: DataFrame, new_rows: DataFrame, order: list[str]) -> DataFrame:
    """S4 (positions). Number new rows of each name after the ones already stored.

    ``new_rows`` has ``name`` and the ``order`` columns (the first numeric);
    the result has ``pos`` = max(stored pos) + 1 + rank among the new rows.
    """
    offsets = existing.groupBy("name").agg((F.max("pos") + 1).alias("_start"))
    numbered = dense_positions(new_rows, "name", order[0], out="_local", extra_order=order[1:])
    return (numbered.join(offsets, "name", "left")
            .withColumn("pos", (F.coalesce(F.col("_start"), F.lit(0)) + F.col("_local")).cast("bigint"))
            .drop("_start", "_local"))


def clear_index(index: DataFrame, names: DataFrame) -> DataFrame:
    """S6. The index without the rows of ``names``; unknown names change nothing."""
    return index.join(names.select("name").distinct(), "name", "left_anti")


def reindex(index: DataFrame, new_rows: DataFrame) -> DataFrame:
    """S7. Replace every document present in ``new_rows`` by those rows."""
    return clear_index(index, new_rows).unionByName(new_rows, allowMissingColumns=True)


def commit_index(spark: SparkSession, changed: DataFrame, path: str, touched_names: DataFrame) -> None:
    """Write ``changed`` (the new full content) back, rewriting only touched shards.

    The touched shards' new rows are staged under the shared checkpoint
    folder first, so the overwrite never reads the files it replaces, and the
    staged copy is removed afterwards.
    """
    shards = stored_shards(spark, path)
    # At most ``shards`` ids: collecting them is bounded by the layout, not the data.
    touched = [r["shard"] for r in touched_names.select(
        shard_of(F.col("name"), shards).alias("shard")).distinct().collect()]
    rows = with_shard(changed.drop("shard"), shards).filter(F.col("shard").isin(touched))
    _change(spark, path, rows.select(*stored_rows(spark, path).columns), touched, shards)


def clear_names(spark: SparkSession, path: str, names: DataFrame) -> None:
    """S6 on a stored index: the rows of ``names`` are gone afterwards."""
    commit_index(spark, clear_index(read_index(spark, path).drop("shard"), names), path, names)


def replace_documents(spark: SparkSession, path: str, new_rows: DataFrame) -> None:
    """S7 on a stored index: every document of ``new_rows`` has exactly those rows afterwards."""
    commit_index(spark, reindex(read_index(spark, path).drop("shard"), new_rows), path, new_rows)
