"""Vector aggregation and extractive-summary ranking.

Centroids use ``Summarizer.mean`` (a partial-then-final aggregate over a vector
column): one row per fragment, one small buffer per document per task, so a
huge document is aggregated by many tasks before a single merge.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.constants import PLAIN_MEAN_LANGUAGES, RANK_DECIMALS, SIF_ALPHA
from docweave.functions.text import terms, words
from docweave.functions.vectors import cosine, exploded, norm, scale, vmax
from docweave.plans.sizing import NAME_BYTES, materialize, maybe_broadcast, vector_row_bytes


def mean_vector(df: DataFrame, key: str = "name", vec: str = "embedding",
                out: str = "centroid") -> DataFrame:
    """A1. Element-wise mean of the vectors of each group, ARRAY<DOUBLE>."""
    return (df.filter(F.col(vec).isNotNull())
            .groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
            .select(key, vector_to_array(F.col("_m")).alias(out)))


def fragment_terms(fragments: DataFrame):
    """Term array of each fragment: the stored ``terms`` column when present."""
    return F.col("terms") if "terms" in fragments.columns else terms(F.col("text"))


# Fragments whose terms one task counts, about: its table of terms stays at tens of MB.
COUNTED_FRAGMENTS = 4096
# Neighbouring fragments that are dealt to the same task.
DEALT_TOGETHER = 256


def counting_tasks(fragments: DataFrame, rows: int) -> int:
    least = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // COUNTED_FRAGMENTS))


def document_frequency(fragments: DataFrame, rows: int | None = None) -> DataFrame:
    """A2. (name, term, df): fragments of the document containing the term.

    When fragments carry ``n_fragments`` it rides along (it is a function of
    ``name``), so ``idf`` needs no second aggregation or join.  With ``rows``, the
    number of fragments, terms are dealt by (name, term) to as many tasks as that
    asks for and counted there: few terms of a document come twice, so a table of
    them before the shuffle would only grow with the files one task reads.
    """
    carry = ["n_fragments"] if "n_fragments" in fragments.columns else []
    found = exploded(fragments, F.array_distinct(fragment_terms(fragments)), "_i", "term", "name", *carry)
    if rows is not None:
        found = found.repartition(counting_tasks(fragments, rows), "name", "term")
    return found.groupBy("name", *carry, "term").agg(F.count(F.lit(1)).cast("bigint").alias("df"))


def vocabulary(fragments: DataFrame) -> DataFrame:
    """A9. Distinct terms of each document."""
    return exploded(fragments, fragment_terms(fragments), "_i", "term", "name").select("name", "term").distinct()


def fragment_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("name").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def idf(doc_freq: DataFrame, fragments: DataFrame, doc_rows: int | None = None) -> DataFrame:
    """A3. Smoothed idf = ln((1 + n) / (1 + df)) + 1, n = fragments of the document.

    ``doc_rows`` (a bound on documents) lets the one-row-per-document counts
    be broadcast, so the large (name, term) table keeps its partitioning.
    """
    if "n_fragments" in doc_freq.columns:
        with_n = doc_freq.withColumnRenamed("n_fragments", "n")
    else:
        counts = fragment_counts(fragments)
        if doc_rows is not None:
            counts = maybe_broadcast(counts, doc_rows, NAME_BYTES)
        with_n = doc_freq.join(counts, "name")
    return with_n.withColumn("idf", F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0)


def dealt_idf(fragments: DataFrame, rows: int) -> DataFrame:
    """A2 and A3 of a known number of fragments: (name, term, df, n, idf), dealt by (name, term).

    Fragments are given their document's count and dealt in short pieces before their terms are taken: no task
    holds the terms of a whole file, and the table of terms is never dealt again by name to meet the counts.
    """
    counts = materialize(fragment_counts(fragments).withColumnRenamed("n", "n_fragments"), "fragment-counts")
    source = "terms" if "terms" in fragments.columns else "text"
    counted = (fragments.select("name", "pos", source).join(maybe_broadcast(counts, counts.count(), NAME_BYTES), "name")
               .repartition(counting_tasks(fragments, rows), "name", F.floor(F.col("pos") / DEALT_TOGETHER)))
    return idf(document_frequency(counted, rows), counted)


def sif_weight(fragments: DataFrame, idf_table: DataFrame, alpha: float = SIF_ALPHA) -> DataFrame:
    """A4. Per fragment, sum over its raw whitespace words of alpha / (alpha + idf(word)).

    Words are matched to the lower-case vocabulary as they are (case and
    punctuation kept), so "Gamma" or "delta." add nothing.  Fragments with no
    match get weight 0.
    """
    occurrences = exploded(fragments, words(F.col("text")), "_i", "term", "name", "pos")
    matched = occurrences.join(idf_table.select("name", "term", "idf"), ["name", "term"])
    weights = matched.groupBy("name", "pos").agg(
        F.sum(F.lit(alpha) / (F.lit(alpha) + F.col("idf"))).alias("weight"))
    return (fragments.join(weights, ["name", "pos"], "left")
            .withColumn("weight", F.coalesce(F.col("weight"), F.lit(0.0))))


def sif_mean_vector(weighted: DataFrame, vec: str = "embedding", out: str = "centroid") -> DataFrame:
    """A5. Mean over fragments of (1 - weight) * v / max(v).

    The per-word weight vectors of the original method are all multiples of
    v / max(v), so one scalar per fragment is enough.  A fragment whose
    maximum coordinate is 0 has no defined scale: it adds nothing to the sum
    and counts in the mean, so every document has a centroid.
    """
    k = F.coalesce(F.try_divide(F.lit(1.0) - F.col("weight"), vmax(F.col(vec))), F.lit(0.0))
    scaled = weighted.select("name", k.alias("_k"), F.col(vec)).filter(F.col(vec).isNotNull())
    scaled = scaled.select("name", scale(F.col(vec), F.col("_k")).alias("_v"))
    return mean_vector(scaled, "name", "_v", out)


def summary_method(lang) -> "F.Column":
    """F15. 'mean' for the languages summarised by plain mean, else 'sif'."""
    return F.when(lang.isin(PLAIN_MEAN_LANGUAGES), F.lit("mean")).otherwise(F.lit("sif"))


def centrality(fragments: DataFrame, centroids: DataFrame, vec: str = "embedding",
               doc_rows: int | None = None, dim: int | None = None) -> DataFrame:
    """A6. Cosine between each fragment and its document centroid (``score``)."""
    c = centroids.select("name", F.col("centroid"), norm(F.col("centroid")).alias("_cn"))
    if doc_rows is not None:
        c = maybe_broadcast(c, doc_rows, 2 * vector_row_bytes(dim or 1536))
    joined = fragments.join(c, "name")
    return joined.withColumn("score", F.round(cosine(F.col(vec), F.col("centroid"),
                                                     None, F.col("_cn")), RANK_DECIMALS)).drop("centroid", "_cn")


def central_fragments(scored: DataFrame, num_candidates: int = 3) -> DataFrame:
    """A7. The ``num_candidates`` most central fragments per document, ``rank`` from 0."""
    w = Window.partitionBy("name").orderBy(F.desc_nulls_last("score"), F.asc("pos"))
    return (scored.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= num_candidates)
            .withColumn("rank", (F.col("_rn") - 1).cast("bigint")).drop("_rn"))
