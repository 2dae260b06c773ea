"""Retrieval: exact vector top-k, existence checks, keywords.

Top-k joins queries to the index on ``name`` (search within one document).
The query side is broadcast when its row bound is known and small, so the
index is scanned in place and never shuffled; a per-partition
``WindowGroupLimit`` then keeps at most ``limit`` rows per query before the
only shuffle.  A hot document therefore never lands in a single task.
Without a bound the join is a shuffle join left to AQE (skew splitting).  When
the questions are known to be too many, those about large documents meet slices
of them instead (``sliced_search``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.constants import RANK_DECIMALS, RETRIEVAL_LIMIT
from docweave.functions.text import terms
from docweave.functions.vectors import cosine, dot, norm
from docweave.operators.sliced_search import SLICE_ROWS, large_documents, sliced_top_k
from docweave.plans.sizing import fits, maybe_broadcast, vector_row_bytes


def _query_side(queries: DataFrame, row_bound: int | None, dim: int | None) -> DataFrame:
    q = queries.select("request_id", "name", F.col("embedding").alias("_q"))
    if row_bound is None:
        return q
    return maybe_broadcast(q, row_bound, vector_row_bytes(dim or 1536))


def _large_apart(queries: DataFrame, index: DataFrame, limit: int, query_rows: int | None, dim: int | None,
                 by_cosine: bool, slice_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """(hits in large documents, index of the others) when the questions are known to be too many to broadcast.

    Else, and without large documents, (None, index).
    """
    if query_rows is None or dim is None or fits(query_rows, vector_row_bytes(dim)):
        return None, index
    large = large_documents(index, slice_rows)
    count = large.count()
    if not count:
        return None, index
    hits, _, _ = sliced_top_k(queries, index, large, limit, dim, by_cosine, slice_rows)
    return hits, index.join(maybe_broadcast(large.select("name"), count, 64), "name", "left_anti")


def _top(scored: DataFrame, limit: int, order) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(*order)
    return (scored.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= limit)
            .withColumn("rank", (F.col("_rn") - 1).cast("bigint")).drop("_rn"))


def top_k_inner_product(queries: DataFrame, index: DataFrame, limit: int = RETRIEVAL_LIMIT,
                        query_rows: int | None = None, dim: int | None = None,
                        carry: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """R1. For each query (request_id, name, embedding), the ``limit`` fragments of
    the same document with the largest inner product, ``rank`` from 0.

    Ranked by the raw score up to ``RANK_DECIMALS``; ties go to the lower pos.
    """
    large, others = _large_apart(queries, index, limit, query_rows, dim, False, slice_rows)
    q = _query_side(queries, query_rows, dim)
    docs = others.select("name", "pos", F.col("embedding").alias("_d"), *carry)
    scored = docs.join(q, "name").select(
        "request_id", "name", "pos", *carry, F.round(dot(F.col("_q"), F.col("_d")), RANK_DECIMALS).alias("score"))
    if large is not None:
        scored = scored.unionByName(_carried(large, index, carry))
    return _top(scored, limit, [F.desc("score"), F.asc("pos")])


def _carried(hits: DataFrame, index: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Hits with columns of their fragments, which are read for the hits alone."""
    return hits.join(index.select("name", "pos", *carry), ["name", "pos"]) if carry else hits


def top_k_cosine(queries: DataFrame, index: DataFrame, limit: int = RETRIEVAL_LIMIT,
                 query_rows: int | None = None, dim: int | None = None,
                 carry: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """R2. Same as R1 ranked by cosine distance ascending; NULL distances
    (a zero vector on either side) rank last."""
    large, others = _large_apart(queries, index, limit, query_rows, dim, True, slice_rows)
    q = _query_side(queries, query_rows, dim).withColumn("_qn", norm(F.col("_q")))
    docs = others.select("name", "pos", F.col("embedding").alias("_d"), *carry)
    scored = docs.join(q, "name").select(
        "request_id", "name", "pos", *carry,
        F.round(F.lit(1.0) - cosine(F.col("_q"), F.col("_d"), F.col("_qn")), RANK_DECIMALS).alias("distance"))
    if large is not None:
        found = large.withColumn("distance", F.round(F.lit(1.0) - F.col("score"), RANK_DECIMALS)).drop("score")
        scored = scored.unionByName(_carried(found, index, carry))
    return _top(scored, limit, [F.asc_nulls_last("distance"), F.asc("pos")])


def fetch_fragments(hits: DataFrame, fragments: DataFrame, hit_rows: int | None = None) -> DataFrame:
    """R4. Attach text to hits by (name, pos); hits without a fragment are dropped.

    Hits of a known small number go to the fragments, which then stay where they are.
    """
    return fragments.select("name", "pos", "text").join(maybe_broadcast(hits, hit_rows, 96), ["name", "pos"])


def indexed_names(index: DataFrame) -> DataFrame:
    """Distinct names of an index (partial aggregation removes hot-name skew)."""
    return index.select("name").distinct()


def already_indexed(docs: DataFrame, index: DataFrame, id_col: str = "content_id") -> DataFrame:
    """R5. Documents whose fingerprint is already a name in the index."""
    names = indexed_names(index).withColumnRenamed("name", id_col)
    return docs.join(names, id_col, "left_semi")


def dedupe_documents(docs: DataFrame, id_col: str = "content_id", order_col: str = "doc_id") -> DataFrame:
    """One row per fingerprint: the row with the smallest ``order_col``.

    ``min(struct(order, row))`` aggregates map-side, so a fingerprint shared by
    a third of all rows is reduced in every task before the shuffle.
    """
    others = [c for c in docs.columns if c not in (id_col, order_col)]
    best = F.min(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_best")
    return docs.groupBy(id_col).agg(best).select(
        id_col, *[F.col("_best")[c].alias(c) for c in [order_col] + others])


def new_documents(docs: DataFrame, index: DataFrame | None, id_col: str = "content_id",
                  order_col: str = "doc_id") -> DataFrame:
    """R6. Documents not yet indexed, exact copies kept once (lowest ``order_col``)."""
    unique = dedupe_documents(docs, id_col, order_col)
    if index is None:
        return unique
    names = indexed_names(index).withColumnRenamed("name", id_col)
    return unique.join(names, id_col, "left_anti")


def unknown_documents(requests: DataFrame, index: DataFrame) -> DataFrame:
    """R7. Requests whose document is not in the index."""
    return requests.join(indexed_names(index), "name", "left_anti")


def query_terms(requests: DataFrame, tasks: int | None = None) -> DataFrame:
    """Terms of each question with their frequency: (request_id, name, term, tf); term NULL if there is none.

    With ``tasks`` they are dealt by (name, term) to so many, counted there and left there for a join.
    """
    found = requests.select("request_id", "name", F.explode_outer(terms(F.col("query"))).alias("term"))
    if tasks is not None:
        found = found.repartition(tasks, "name", "term")
    return found.groupBy("request_id", "name", "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))


def extract_keywords(requests: DataFrame, idf_table: DataFrame, k: int | None = None,
                     tasks: int | None = None) -> DataFrame:
    """R8. Keywords of every question, comma-separated: (request_id, name, keywords, matched).

    A keyword is a question term found in the target document's vocabulary,
    ranked by tf * idf (idf over that document's fragments; ties by term).
    A question with no such term (or of an unknown document) has
    ``matched`` false and its own terms as keywords, by tf, then term.  ``k`` keeps
    the first k keywords; by default all are kept.  A group is as large as its question.
    ``tasks``: those that ``idf_table`` is dealt to by (name, term), if it is.
    """
    known = idf_table.select("name", "term", "idf")
    scored = query_terms(requests, tasks).join(known, ["name", "term"], "left").withColumn(
        "found", F.col("idf").isNotNull())
    weight = F.col("tf") * F.coalesce("idf", F.lit(1.0))
    ranked = F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct(
        (-F.round(weight, RANK_DECIMALS)).alias("w"), "term", "found"))))
    groups = scored.groupBy("request_id", "name").agg(ranked.alias("all"), F.bool_or("found").alias("matched"))
    words = F.transform(F.filter("all", lambda x: x["found"] | ~F.col("matched")), lambda x: x["term"])
    if k is not None:
        words = F.slice(words, 1, k)
    return groups.select("request_id", "name", F.array_join(words, ",").alias("keywords"), "matched")
