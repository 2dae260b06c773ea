"""Extractive summary context for every document at once.

route by language -> centroid (plain mean, or SIF-weighted) -> cosine of
each fragment to its centroid -> top candidates -> labels -> token-budget
cut -> numbered context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.constants import SUMMARY_CANDIDATES
from docweave.functions.text import token_count
from docweave.operators.fragments import label_paragraph, numbered_list
from docweave.operators.summary import (
    central_fragments, centrality, document_frequency, idf, mean_vector, sif_mean_vector,
    sif_weight, summary_method,
)
from docweave.operators.tokens import cut_to_budget
from docweave.plans.sizing import NAME_BYTES, maybe_broadcast
from docweave.plans.answer import context_budget


def centroids(fragments: DataFrame, methods: DataFrame, doc_rows: int | None = None) -> DataFrame:
    """(name, centroid): plain mean for 'mean' documents, SIF centroid for the rest.

    ``fragments`` has (name, pos, text, embedding); ``methods`` has (name, method),
    broadcast when ``doc_rows`` bounds it.
    """
    if "lang" in fragments.columns:
        # the language rides on each fragment: route without a join
        tagged = fragments.withColumn("method", summary_method(F.col("lang")))
    else:
        if doc_rows is not None:
            methods = maybe_broadcast(methods, doc_rows, NAME_BYTES)
        tagged = fragments.join(methods, "name")
    plain = tagged.filter(F.col("method") == "mean")
    sif = tagged.filter(F.col("method") == "sif").drop("method")
    idf_table = idf(document_frequency(sif), sif, doc_rows)
    return mean_vector(plain).unionByName(sif_mean_vector(sif_weight(sif, idf_table)))


def summary_candidates(fragments: DataFrame, docs: DataFrame,
                       num_candidates: int = SUMMARY_CANDIDATES, doc_rows: int | None = None,
                       dim: int | None = None) -> DataFrame:
    """Ranked, labelled candidates (name, rank, pos, score, label, n_tokens)."""
    methods = docs.select("name", summary_method(F.col("lang")).alias("method"))
    scored = centrality(fragments, centroids(fragments, methods, doc_rows), doc_rows=doc_rows, dim=dim)
    top = central_fragments(scored, num_candidates)
    return (top.withColumn("label", label_paragraph(F.col("pos"), F.col("text")))
            .withColumn("n_tokens", token_count(F.col("label"))))


def summary_context(fragments: DataFrame, docs: DataFrame,
                    num_candidates: int = SUMMARY_CANDIDATES, budget: int | None = None,
                    doc_rows: int | None = None, dim: int | None = None) -> DataFrame:
    """(name, method, n_fragments, context) per document with fragments."""
    budget = context_budget() if budget is None else budget
    ranked = summary_candidates(fragments, docs, num_candidates, doc_rows, dim)
    kept = cut_to_budget(ranked, "name", budget)
    ctx = numbered_list(kept, "name", "rank", "label", out="context")
    methods = maybe_broadcast(docs.select("name", summary_method(F.col("lang")).alias("method")),
                              doc_rows, NAME_BYTES)
    return ctx.join(methods, "name").select(
        "name", "method", F.col("n_items").alias("n_fragments"), "context")
