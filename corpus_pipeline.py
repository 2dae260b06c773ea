"""A training-data pipeline over ``documents`` built from the operators of ``docweave.llm``.

Each stage takes the rows that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.bpe_codec import encode_decode
from docweave.llm.common import staged, table
from docweave.llm.decontaminate import benchmark_leaks, without_leaks
from docweave.llm.line_dedup import drop_boilerplate
from docweave.llm.near_dups import one_of_each
from docweave.llm.quality_classifier import fit_quality, good_documents
from docweave.llm.queries import BYTE_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores as good and not toxic."""
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; ``n_chars`` follows a changed text.

    Copies are still there at this stage and count as one document of their source.
    """
    clean = drop_boilerplate(docs, "source", "text", copies_once=True)
    size = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, benchmark_leaks(docs, table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_le, round_trip) of every document."""
    # Workers that ran the stages before have less memory left for remembered pieces.
    return encode_decode(docs, public_tokenizers.path(BYTE_BPE), memo=200_000).drop("decoded")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encoding),
]

# The classifier, the similarity join and the codec are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
