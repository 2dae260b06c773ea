"""Exact top-k inside large documents for more questions than can be broadcast.

A document of many fragments is cut into slices of like direction: the angle
between a fragment's vector and the document's mean vector decides the band, and
a band with many fragments is several slices.  A slice's summary (its least and
largest angle and norm) bounds what any of its fragments can score for a
question: with the question at angle a to the mean, no vector at angle b is
closer to it than ``|a - b|``, so its inner product is at most
``|q| |v| cos(a - b)`` (Cauchy-Schwarz for equal angles).

Questions meet slices, not documents: every question starts with its most
promising slices, and the k-th best score so far tells which others can be
skipped; those that remain follow in rounds of growing size.  The work of a hot
document is thus dealt by (document, slice) over many tasks, and only vectors of
slices that somebody needs are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.constants import RANK_DECIMALS
from docweave.functions.vectors import cosine, dot, norm
from docweave.operators.summary import mean_vector
from docweave.plans.sizing import materialize, maybe_broadcast, vector_row_bytes

SLICE_ROWS = 4096
# A round takes slices with so many times the fragments of the one before.
GROWTH = 4
# Bounds are compared with this slack, relative to the norms: far above rounding, far below what a ranking shows.
SLACK = 1e-9


def _angle(v: Column, w: Column) -> Column:
    """Angle between two vectors; null if one has no direction or the lengths differ."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(v, w))))


def sliced(index: DataFrame, large: DataFrame, dim: int, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, slices, pivots) of the documents in ``large`` (name, n), stored.

    ``vectors`` is (name, band, part, pos, _d); ``slices`` has one row for each
    (name, band, part) with its size ``n``, angles ``a0`` to ``a1`` and norms ``n0`` to
    ``n1``; ``pivots`` is (name, pivot).  Vectors without an angle have null angles.
    """
    documents = large.count()
    vec = index.select("name", "pos", F.col("embedding").alias("_d"))
    small = maybe_broadcast(large, documents, 64)
    mine = vec.join(small, "name")
    pivots = materialize(mean_vector(mine.filter(F.size("_d") == dim), "name", "_d", "pivot"), "pivots")
    near = mine.join(maybe_broadcast(pivots, documents, vector_row_bytes(dim)), "name", "left")
    placed = materialize(near.select("name", "pos", "_d", "n", norm(F.col("_d")).alias("_n"),
                                     _angle(F.col("_d"), F.col("pivot")).alias("_a")), "slice-angles")
    width = materialize(placed.groupBy("name").agg(F.min("_a").alias("lo"), F.max("_a").alias("hi")), "slice-widths")
    bands = F.ceil(F.col("n") / slice_rows)
    spread = F.coalesce(F.try_divide(F.col("_a") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    band = F.when(F.col("_a").isNull(), F.lit(-1)).otherwise(F.least(bands - 1, F.floor(spread * bands)))
    banded = materialize(placed.join(maybe_broadcast(width, documents, 64), "name").select(
        "name", band.cast("int").alias("band"), "pos", "_d", "_n", "_a"), "slice-bands")
    parts = materialize(banded.groupBy("name", "band").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int")
                                                           .alias("parts")), "slice-parts")
    dealt = banded.join(maybe_broadcast(parts, parts.count(), 64), ["name", "band"])
    vectors = materialize(dealt.select("name", "band", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int").alias("part"),
                                       "pos", "_d", "_n", "_a"), "slice-vectors")
    slices = materialize(vectors.groupBy("name", "band", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("_a").alias("a0"), F.max("_a").alias("a1"),
        F.min("_n").alias("n0"), F.max("_n").alias("n1")), "slices")
    return vectors.drop("_n", "_a"), slices, pivots


def _bound(by_cosine: bool) -> Column:
    """The largest score that a fragment of a slice (a0, a1, n0, n1) can have for a question (_qn, _qa)."""
    gap = F.greatest(F.lit(0.0), F.col("_qa") - F.col("a1"), F.col("a0") - F.col("_qa"))
    cos = F.coalesce(F.when(F.col("a0").isNull() | F.col("_qa").isNull(), F.lit(1.0)).otherwise(F.cos(gap)), F.lit(1.0))
    if by_cosine:
        # Vectors without a length have no cosine and come last of all.
        return F.when(F.col("n1") == 0, F.lit(-2.0)).otherwise(cos + SLACK)
    length = F.col("_qn") * F.col("n1")
    return F.greatest(length * cos, F.col("_qn") * F.col("n0") * cos) + length * SLACK + SLACK


def _best(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), F.asc("pos"))
    return (rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
            .select("request_id", "name", "pos", "score"))


def sliced_top_k(queries: DataFrame, index: DataFrame, large: DataFrame, limit: int, dim: int,
                 by_cosine: bool = False, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, list[int], int]:
    """(hits, looked, all): best fragments (request_id, name, pos, score) of questions about ``large`` documents.

    ``score`` is the inner product or the cosine, null ones last, the lower
    ``pos`` first in a tie.  ``looked`` says how many (question, slice) pairs each
    round scored, of ``all`` there are.
    """
    vectors, slices, pivots = sliced(index, large, dim, slice_rows)
    documents = large.count()
    asked = queries.select("request_id", "name", F.col("embedding").alias("_q")).join(
        maybe_broadcast(large.select("name"), documents, 64), "name")
    asked = asked.join(maybe_broadcast(pivots, documents, vector_row_bytes(dim)), "name", "left")
    asked = materialize(asked.select("request_id", "name", "_q", norm(F.col("_q")).alias("_qn"),
                                     _angle(F.col("_q"), F.col("pivot")).alias("_qa")), "slice-questions")
    few = slices.count()
    order = Window.partitionBy("request_id").orderBy(F.desc("bound"), "band", "part")
    pairs = (asked.drop("_q").join(maybe_broadcast(slices, few, 96), "name")
             .withColumn("bound", _bound(by_cosine)).select("request_id", "name", "band", "part", "n", "bound"))
    pairs = materialize(pairs.withColumn("ahead", F.coalesce(F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "slice-pairs")
    total = pairs.count()
    value = cosine(F.col("_q"), F.col("_d"), F.col("_qn")) if by_cosine else dot(F.col("_q"), F.col("_d"))
    score = F.round(value, RANK_DECIMALS).alias("score")
    hits, looked, low, high = None, [], 0, max(limit, slice_rows)
    most = pairs.agg(F.max("ahead")).first()[0]
    while most is not None and low <= most:
        chosen = pairs.filter((F.col("ahead") >= low) & (F.col("ahead") < high))
        if hits is not None:
            # Below the k-th score so far nothing can enter; a question with fewer hits, or null ones, looks on.
            least = hits.groupBy("request_id").agg(F.count("score").alias("_k"), F.min("score").alias("_least"))
            chosen = chosen.join(least, "request_id", "left").filter(
                F.coalesce((F.col("_k") < limit) | (F.col("bound") >= F.col("_least")), F.lit(True))).drop("_k", "_least")
        chosen = materialize(chosen.select("request_id", "name", "band", "part"), "slice-chosen")
        count = chosen.count()
        looked.append(count)
        if count:
            needed = maybe_broadcast(chosen.select("name", "band", "part").distinct(), min(few, count), 64)
            met = (vectors.join(needed, ["name", "band", "part"], "left_semi")
                   .join(chosen.join(asked.select("request_id", "_q", "_qn"), "request_id"), ["name", "band", "part"]))
            found = met.select("request_id", "name", "pos", score)
            hits = materialize(_best(found if hits is None else hits.unionByName(found), limit), "slice-hits")
        low, high = high, high * GROWTH
    if hits is None:
        hits = asked.select("request_id", "name", F.lit(0).cast("bigint").alias("pos"),
                            F.lit(0.0).alias("score")).limit(0)
    return hits, looked, total


def large_documents(index: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(name, n) of the documents with more than ``slice_rows`` fragments, stored."""
    counts = index.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.filter(F.col("n") > slice_rows), "large-documents")
