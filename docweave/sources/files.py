"""File and page sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.constants import SUPPORTED_SUFFIXES

_SUFFIX = "(" + "|".join(s.lstrip(".").replace(".", r"\.") for s in SUPPORTED_SUFFIXES) + ")"


def read_text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S1. One row per UTF-8 text file: (name := file name, uri, text)."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("uri"),
        F.col("value").alias("text"))


def source_kind(uri: Column) -> Column:
    """S2. 'pdf' | 'txt' | 'docx' from the path suffix, else 'unsupported' (also for NULL).

    Query and fragment are cut from http(s) addresses only: a file name may hold ``#`` or ``?``.
    """
    path = F.lower(F.regexp_replace(uri, r"(?i)^(https?://[^?#]*)[?#].*$", "$1"))
    kind = F.coalesce(F.regexp_extract(path, r"\." + _SUFFIX + "$", 1), F.lit(""))
    return F.when(kind == "", F.lit("unsupported")).otherwise(kind)


def select_supported(df: DataFrame, uri_col: str = "uri") -> DataFrame:
    """S2. Adds ``kind`` and keeps supported files only."""
    return df.withColumn("kind", source_kind(F.col(uri_col))).filter(F.col("kind") != "unsupported")


def page_documents(pages: DataFrame) -> DataFrame:
    """S3. Crawled pages as (name, url, html)."""
    return pages.select(F.col("page_id").alias("name"), "url", "html")
