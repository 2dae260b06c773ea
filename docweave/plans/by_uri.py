"""Answers and summaries asked for by document URI, ``content_id/lang`` (F7 with R9 and A8).

A URI names a document by its content and carries the language that was found at
ingest, which decides how it is summarised.  A URI without either part, or of a
document that is not indexed, is answered with a status and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.document_rows import summary_rows
from docweave.operators.identity import make_uri, parse_uri
from docweave.plans.answer import answer_context, context_budget
from docweave.plans.sizing import NAME_BYTES, materialize, maybe_broadcast


def by_uri(requests: DataFrame, uri_col: str = "uri") -> DataFrame:
    """``requests`` with the ``name`` and ``lang`` of their URI, null where the URI has no such part."""
    name, lang = parse_uri(F.col(uri_col))
    return requests.withColumns({"name": F.nullif(name, F.lit("")), "lang": F.nullif(lang, F.lit(""))})


def answer_by_uri(requests: DataFrame, fragments: DataFrame, dim: int, request_rows: int | None = None,
                  **settings) -> DataFrame:
    """(request_id, uri, keywords, status, n_fragments, context) of requests (request_id, uri, query).

    ``fragments`` are named by content id.  Besides those of ``answer_context`` the
    status may be ``not found``: the URI names no document.
    """
    asked = by_uri(requests)
    whole = F.col("name").isNotNull() & F.col("lang").isNotNull()
    found = answer_context(asked.filter(whole).select("request_id", "name", "query"), fragments, dim,
                           request_rows=request_rows, **settings)
    answered = asked.filter(whole).select("request_id", "uri").join(found.drop("name"), "request_id")
    others = asked.filter(~whole).select(
        "request_id", "uri", F.lit(None).cast("string").alias("keywords"), F.lit("not found").alias("status"),
        F.lit(0).cast("bigint").alias("n_fragments"), F.lit(None).cast("string").alias("context"))
    return answered.select(others.columns).unionByName(others)


def summary_by_uri(requests: DataFrame, rows: DataFrame, budget: int | None = None,
                   request_rows: int | None = None) -> DataFrame:
    """(request_id, uri, status, method, n_fragments, context) of requests (request_id, uri).

    ``rows`` are stored ``document_rows`` named by content id; only those asked for
    are summarised, each by the language of its URI, and once for every URI.
    """
    asked = by_uri(requests)
    wanted = asked.filter("name IS NOT NULL AND lang IS NOT NULL").select("name", "lang").distinct()
    own = rows.drop("lang").join(maybe_broadcast(wanted, request_rows, NAME_BYTES), "name")
    own = materialize(own.withColumn("name", make_uri(F.col("name"), F.col("lang"))), "asked-rows")
    found = summary_rows(own, context_budget() if budget is None else budget).withColumnRenamed("name", "uri")
    return requests.select("request_id", "uri").join(found, "uri", "left").select(
        "request_id", "uri", F.when(F.col("context").isNull(), "not found").otherwise("summarised").alias("status"),
        "method", F.coalesce("n_fragments", F.lit(0)).cast("bigint").alias("n_fragments"), "context")
