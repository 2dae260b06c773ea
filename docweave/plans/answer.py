"""Answer context for many questions at once (the flagship pipeline).

clean questions -> keywords (TF-IDF against the target document) -> keyword
vector -> exact top-k fragments of that document -> "paragraph {pos}: {text}"
labels -> inclusive token-budget cut -> numbered context string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.constants import (
    CHAT_MODELS, DEFAULT_CHAT_MODEL, RESERVE_TOKENS, RETRIEVAL_LIMIT,
)
from docweave.functions.text import token_count
from docweave.operators.embedding import embed_query, hashing_embedder
from docweave.operators.fragments import label_paragraph, numbered_list
from docweave.operators.retrieval import extract_keywords, fetch_fragments, top_k_cosine, top_k_inner_product
from docweave.operators.summary import counting_tasks, dealt_idf, document_frequency, idf
from docweave.operators.tokens import cut_to_budget
from docweave.plans.sizing import NAME_BYTES, materialize, maybe_broadcast


def context_budget(model: str = DEFAULT_CHAT_MODEL) -> int:
    windows = {m[0]: m[1] for m in CHAT_MODELS}
    if model not in windows:
        raise ValueError(f"unknown chat model {model!r}")
    window = windows[model]
    return window - RESERVE_TOKENS


def dealt_keywords(requests: DataFrame, fragments: DataFrame, fragment_rows: int, k: int | None = None) -> DataFrame:
    """Keywords of every question; terms of both sides are dealt once, to tasks whose number follows the fragments."""
    return extract_keywords(requests, dealt_idf(fragments, fragment_rows), k, counting_tasks(fragments, fragment_rows))


def answer_hits(requests: DataFrame, fragments: DataFrame, dim: int,
                limit: int = RETRIEVAL_LIMIT, k: int | None = None,
                request_rows: int | None = None, cosine: bool = False,
                fragment_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keywords per request and the ranked, labelled hits (before the budget cut).

    Fragments of documents that nobody asks about are dropped first, so
    ``request_rows`` bounds the documents of every later step.  ``fragment_rows``, if
    known, sets how many tasks count the terms.
    """
    asked = maybe_broadcast(requests.select("name").distinct(), request_rows, NAME_BYTES)
    fragments = fragments.join(asked, "name", "left_semi")
    if fragment_rows is None:
        found = extract_keywords(requests, idf(document_frequency(fragments), fragments, request_rows), k)
    else:
        found = dealt_keywords(requests, fragments, fragment_rows, k)
    # One row for each question: stored, as both the search and the result need it.
    keywords = materialize(found, "keywords")
    query_vectors = embed_query(keywords, dim).select("request_id", "name", "embedding")
    index = hashing_embedder(fragments, dim)
    search = top_k_cosine if cosine else top_k_inner_product
    best = search(query_vectors, index, limit, request_rows, dim)
    hits = fetch_fragments(best, fragments, None if request_rows is None else request_rows * limit)
    labelled = (hits.withColumn("label", label_paragraph(F.col("pos"), F.col("text")))
                .withColumn("n_tokens", token_count(F.col("label"))))
    return keywords, labelled


def answer_context(requests: DataFrame, fragments: DataFrame, dim: int,
                   limit: int = RETRIEVAL_LIMIT, budget: int | None = None,
                   k: int | None = None, request_rows: int | None = None,
                   model: str = DEFAULT_CHAT_MODEL, cosine: bool = False,
                   fragment_rows: int | None = None) -> DataFrame:
    """(request_id, name, keywords, status, n_fragments, context), one row for each request.

    ``status``: ``answered``; ``no match`` if no term of the question is in its
    document (the question's own terms are then searched); ``unknown
    document`` if nothing of it is indexed (no fragments, context NULL).
    ``cosine`` ranks by cosine distance in place of the inner product.
    """
    budget = context_budget(model) if budget is None else budget
    keywords, labelled = answer_hits(requests, fragments, dim, limit, k, request_rows, cosine, fragment_rows)
    kept = cut_to_budget(labelled, "request_id", budget)
    ctx = numbered_list(kept, "request_id", "rank", "label", out="context")
    status = (F.when(F.col("context").isNull(), "unknown document").when(F.col("matched"), "answered")
              .otherwise("no match"))
    return keywords.join(ctx, "request_id", "left").select(
        "request_id", "name", "keywords", status.alias("status"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_fragments"), "context")
