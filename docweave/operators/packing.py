"""Greedy packing (T2) of a document of any size, without holding it in one task.

Let a fragment's value be the tokens before it.  A batch that starts at value u
holds the fragments with values u to u + limit, and the next one starts at the
least value above that; so batches are a path over the document's distinct
values, and at most one of them starts in any bucket of limit + 1 values.
Every value learns its successor from the next bucket; pointer doubling from 0
then finds the first 2, 4, 8, ... starts with their batch numbers, and each
start meets its fragments in the one or two buckets that it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.plans.scan import running_total
from docweave.plans.sizing import materialize


def successors(values: DataFrame, limit: int) -> DataFrame:
    """(name, v, next): for each distinct value of a document the least one above v + limit; none for the last."""
    width = limit + 1
    buckets = values.withColumn("b", F.floor(F.col("v") / width)).groupBy("name", "b").agg(
        F.sort_array(F.collect_set("v")).alias("vs"))
    buckets = materialize(buckets, "pack-buckets")
    order = Window.partitionBy("name").orderBy("b")
    heads = buckets.select("name", "b", F.col("vs")[0].alias("low")).select(
        "name", "b", F.lead("b").over(order).alias("b1"), F.lead("low").over(order).alias("low1"),
        F.lead("low", 2).over(order).alias("low2"))
    beside = buckets.select("name", (F.col("b") - 1).alias("b"), F.col("vs").alias("after"))
    met = buckets.join(heads, ["name", "b"]).join(beside, ["name", "b"], "left")
    later = F.when(F.col("b1") == F.col("b") + 1, F.col("low2")).otherwise(F.col("low1"))
    found = met.select("name", "after", later.alias("later"), F.explode("vs").alias("v"))
    reach = F.col("v") + F.lit(width)
    inside = F.array_min(F.filter("after", lambda w: w >= reach))
    return found.select("name", "v", F.coalesce(inside, F.col("later")).alias("next")).filter(F.col("next").isNotNull())


def batch_starts(values: DataFrame, limit: int) -> DataFrame:
    """(name, v, batch): the values at which batches start, numbered from 0."""
    jumps = materialize(successors(values, limit), "pack-jumps")
    starts = materialize(values.groupBy("name").agg(F.min("v").alias("v")).withColumn(
        "batch", F.lit(0).cast("bigint")), "pack-starts")
    step = 1
    while True:
        more = starts.join(jumps, ["name", "v"]).select(
            "name", F.col("next").alias("v"), (F.col("batch") + step).alias("batch"))
        grown = materialize(starts.unionByName(more), "pack-starts")
        if grown.count() == starts.count():
            return starts
        far = jumps.select("name", F.col("v").alias("next"), F.col("next").alias("far"))
        jumps = materialize(jumps.join(far, ["name", "next"]).select("name", "v", F.col("far").alias("next")),
                            "pack-jumps")
        starts, step = grown, 2 * step


def pack_large(fragments: DataFrame, limit: int) -> DataFrame:
    """``fragments`` (name, pos, n_tokens, ...) with ``batch``; a document spreads over many tasks."""
    if limit < 0:
        raise ValueError("the reserve is larger than the model's limit")
    valued = running_total(fragments, ["name"], "pos", F.col("n_tokens"), "_before")
    valued = materialize(valued.withColumn("_before", F.col("_before").cast("bigint")), "pack-values")
    starts = batch_starts(valued.select("name", F.col("_before").alias("v")).distinct(), limit)
    width = limit + 1
    first = F.floor(F.col("v") / width)
    reached = starts.select("name", "v", "batch", F.explode(F.array_distinct(F.array(
        first, F.floor((F.col("v") + limit) / width)))).alias("_b"))
    rows = valued.withColumn("_b", F.floor(F.col("_before") / width))
    return (rows.join(reached, ["name", "_b"]).filter(F.col("_before").between(F.col("v"), F.col("v") + limit))
            .select(*fragments.columns, "batch"))
