"""How the operators bind to the driver's tables.

* text operators: ``name := doc_id`` of ``documents`` (``page_id`` of ``pages``);
* vector operators on stored vectors: ``name := label``, ``pos := vec_id`` of ``embeddings``;
* questions: every user turn of ``conversations`` is a question about the
  document whose ``doc_id`` equals its ``conv_id`` (an equi-join, so a
  conversation without such a document is an unknown-document request).

Every table is read whole.  Row bounds for broadcast decisions come from
``count()`` on the source Parquet table, answered from file footers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import strip_ws
from docweave.plans.sizing import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def row_bound(spark: SparkSession, sf_dir: str, name: str) -> int:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("name"), "doc_id", "text", "lang", "source")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as (request_id, name, query), before cleaning."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("request_id"),
        F.col("conv_id").alias("name"), F.col("text").alias("query"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 applied: trimmed, non-blank questions."""
    raw = raw_requests(spark, sf_dir)
    return raw.withColumn("query", strip_ws(F.col("query"))).filter(F.col("query") != "")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors as an index: (name := label, pos := vec_id, embedding)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("name"), F.col("vec_id").alias("pos"), "embedding")
