"""Exact duplicates with a heavy-hitter split.

Texts are equal when identical after every run of blanks has become one space;
they are compared by the SHA-256 of that form.  A Misra-Gries summary of
``counters`` counters is kept over the digests of every input partition, and
summaries are merged in a tree, so that every digest with more than a
``1 / (counters + 1)`` share of the rows is in the final one.  These candidates
are counted exactly in a second pass; the verified ones, at most ``counters``
by construction, are broadcast with their winner, and their rows are decided
where they are read.  The other digests, none of which holds more than that
share, are shuffled in the ordinary way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import WORD_GAP, map_partitions, packed, sized, staged

# Summaries merged by one task.
FAN_IN = 64

_SUMMARY = T.StructType([T.StructField("part", T.LongType()), T.StructField("digest", T.BinaryType()),
                         T.StructField("n", T.LongType())])


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text with every run of blanks replaced by one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " ").cast("binary"), 256)


def decrement(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """A Misra-Gries summary cut back to ``counters`` entries.

    The ``counters + 1``-th largest count is taken off every entry and those
    left without any go; each unit taken off one entry is taken off ``counters``
    others, so no count is ever too low by more than total / (counters + 1).
    """
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {digest: n - cut for digest, n in counts.items() if n > cut}


def _summaries(rows: DataFrame, counters: int) -> DataFrame:
    """One summary (part, digest, n) for each part of ``rows`` (part, digest[, n]); a part's rows stand together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, {}

        def summary() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()),
                 pa.array(list(counts.values()), pa.int64())], names=["part", "digest", "n"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for one in pc.unique(batch.column("part")).to_pylist():
                if counts and one != part:
                    yield summary()
                    counts = {}
                part = one
                mine = table.filter(pc.equal(table["part"], one))
                if "n" in mine.column_names:
                    found = zip(mine["digest"].to_pylist(), mine["n"].to_pylist())
                else:
                    seen = pc.value_counts(mine["digest"].combine_chunks())
                    found = zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist())
                for digest, n in found:
                    counts[digest] = counts.get(digest, 0) + n
                counts = decrement(counts, counters)
        if counts:
            yield summary()

    return map_partitions(rows, run, _SUMMARY)


def frequent_digests(rows: DataFrame, counters: int, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, n): a superset of the digests that hold more than a 1 / (counters + 1) share of ``rows``.

    At most ``counters`` rows.  ``n`` is at most the digest's count and at most
    that share of all rows below it.  Every partition that reads ``rows`` makes one
    summary; a merging task takes those of ``fan_in`` parts.
    """
    level = staged(_summaries(rows.select(F.spark_partition_id().cast("long").alias("part"), "digest"), counters),
                   "misra-gries")
    last = level.agg(F.max("part")).first()[0]
    while last:
        parts = level.withColumn("part", F.floor(F.col("part") / fan_in))
        level = staged(_summaries(parts.repartition("part").sortWithinPartitions("part"), counters), "misra-gries")
        last //= fan_in
    return level.select("digest", "n")


def _share(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_at, group_size) of ``rows`` (digest, doc_id, at)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "at")).alias("first")
    return rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.at").alias("keep_at"), "group_size")


def _split(docs: DataFrame, counters: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, heavy): every row as (digest, doc_id, at, keep_id, keep_at, group_size), and the verified frequent
    digests as (digest, keep_id, keep_at, group_size)."""
    rows = staged(docs.select(
        F.unhex(text_digest(docs[text_col])).alias("digest"), docs[id_col].cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("at")), "digests")
    total = rows.count()
    candidates = F.broadcast(frequent_digests(rows, counters).select("digest"))  # at most ``counters`` rows
    heavy = staged(_share(rows.join(candidates, "digest", "left_semi")).filter(
        F.col("group_size") * (counters + 1) > total), "heavy-digests")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return rows.join(F.broadcast(heavy), "digest").unionByName(light.join(_share(light), "digest")), heavy


def exact_duplicates(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Of equal texts the row with the smallest id stays: ``keep_id`` is its id,
    ``group_size`` the number of rows with that text, the one that stays included.
    A null text equals an empty one.  Exactly one row of a group is kept: of rows
    that repeat the smallest id any one (they differ in nothing here), and one
    with a null id only where no row of the group has an id (``keep_id`` is null).
    Texts are read whole; an empty table gives an empty result; other columns are
    not read.
    """
    rows, _ = _split(docs, counters, id_col, text_col)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row for each text: the one with the smallest id.

    Copies of frequent texts go where they are read, by a broadcast of the
    winners; other copies go by a join on digest and id.  Of rows that repeat the
    winning id and text one stays.
    """
    rows, heavy = _split(docs, counters, id_col, text_col)
    rows = staged(rows, "exact-verdicts")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = rows.filter(~wins).join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    lost = sized(staged(lost.select("digest", "doc_id").distinct(), "exact-lost"), 64)
    again = staged(rows.filter(wins).groupBy("digest", "doc_id").count().filter("count > 1")
                   .select("digest", "doc_id"), "exact-repeats")
    many = again.count()
    again = sized(again, 64, many)

    row, key = packed(docs), docs[id_col].cast("long").alias("doc_id")
    tagged = docs.select(row, F.unhex(text_digest(docs[text_col])).alias("digest"), key)
    winner = F.broadcast(heavy.select("digest", "keep_id", F.lit(True).alias("frequent")))
    stay = tagged.join(winner, "digest", "left").filter(F.col("frequent").isNull() | wins)
    stay = stay.select("row", "digest", "doc_id")

    def same(other: DataFrame) -> Column:
        return (stay["digest"] == other["digest"]) & stay["doc_id"].eqNullSafe(other["doc_id"])

    stay = stay.join(lost, same(lost), "left_anti")
    if many:
        stay = stay.join(again, same(again), "left_anti").unionByName(
            stay.join(again, same(again), "left_semi").dropDuplicates(["digest", "doc_id"]))
    return stay.select("row.*")
