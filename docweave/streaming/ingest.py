"""Streaming ingest (D1) and stream de-duplication.

Files arriving in folders are fragmented, fingerprinted and appended to the
index exactly once per fingerprint.  One query may read any number of folders;
``foreachBatch`` is at-least-once, so each micro-batch first drops the
fingerprints that the index already holds.  All rows of a document are written
by one task into one file, so after a failure at any point a document is stored
whole or not at all, and the replay adds just what is missing.  Queries with
different checkpoints may feed one index too, at the same time: a batch reads
what is stored and appends to it under the index's lock.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.constants import DEFAULT_EMBEDDING_MODEL, PACK_MAX_TOKENS
from docweave.functions.text import clean_lines
from docweave.operators.cost import embedding_cost, model_catalog
from docweave.operators.embedding import Embedder, embed_batches, hashing_embedder
from docweave.operators.identity import content_id_of, make_uri
from docweave.operators.language import with_language
from docweave.operators.tokens import document_batches, pack_document_batches
from docweave.sources.index import file_system, open_index, small_file, stored_names, stored_rows, with_shard

TEXT_FILE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])

# Bytes of text that one writing task takes about.
TASK_BYTES = 32 << 20


def dedupe_stream(df: DataFrame, id_col: str = "content_id", watermark_col: str | None = None,
                  delay: str | None = None) -> DataFrame:
    """D2. Drop repeated fingerprints on a stream (state keyed by fingerprint).

    With ``watermark_col``/``delay`` the state is bounded: duplicates are only
    caught within the watermark delay (``dropDuplicatesWithinWatermark``).
    Without them every fingerprint ever seen stays in state, which grows
    without bound.
    """
    if watermark_col and delay:
        return df.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark([id_col])
    return df.dropDuplicates([id_col])


def documents_from_files(stream: DataFrame) -> DataFrame:
    """Whole-text file rows -> (name := fingerprint, source := file, text, fragments); files without text are left out."""
    frags = clean_lines(F.col("value"))
    return (stream.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"),
                          frags.alias("fragments"))
            .filter(F.size("fragments") > 0)
            .withColumn("name", content_id_of(F.col("fragments"))))


def lock_path(index_path: str) -> str:
    return index_path.rstrip("/") + "_lock"


def release_lock(spark: SparkSession, index_path: str) -> None:
    """Removes the lock that a writer left behind when its process died."""
    fs, path = file_system(spark, lock_path(index_path))
    fs.delete(path, False)


@contextmanager
def index_lock(spark: SparkSession, index_path: str, owner: str, patience: float = 600.0):
    """Holds the index's lock file; a lock of the same ``owner``, from before a crash, is taken over.

    Creating a file that must not exist is atomic on the storages that Spark's
    streaming itself relies on.  Waits ``patience`` seconds for another owner.
    """
    fs, path = file_system(spark, lock_path(index_path))
    until = time.monotonic() + patience
    while True:
        try:
            out = fs.create(path, False)
            out.write(bytearray(owner.encode("utf-8")))
            out.close()
            break
        except Py4JJavaError:
            try:
                holder = small_file(spark, lock_path(index_path))
            except (AnalysisException, Py4JJavaError):
                holder = None  # gone between the two looks
            if holder == owner:
                break
            if time.monotonic() > until:
                raise TimeoutError(f"the index at {index_path} is locked by {holder}") from None
            time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(path, False)


def index_fragments(docs: DataFrame, dim: int, max_tokens: int, embedder: Embedder | None) -> DataFrame:
    """(name, pos, text, embedding, n_tokens, batch, uri, source[, shard]) of documents (name, fragments, ...), row-wise.

    Fragments are packed into the embedder's batches; a caller's ``embedder`` is
    called once for each of them.
    """
    carried = tuple(c for c in ("uri", "source", "shard") if c in docs.columns)
    if embedder is None:
        packed = pack_document_batches(docs, max_tokens, keep=carried)
        return hashing_embedder(packed, dim).select("name", "pos", "text", "embedding", "n_tokens", "batch", *carried)
    batches = document_batches(docs, max_tokens, keep=carried)
    return embed_batches(batches, dim, embedder, keep=carried, with_tokens=True).select(
        "name", "pos", "text", "embedding", "n_tokens", "batch", *carried)


def ingest_batch(batch: DataFrame, index_path: str, dim: int, shards: int | None = None, owner: str = "batch",
                 profiles: DataFrame | None = None, max_tokens: int = PACK_MAX_TOKENS,
                 embedder: Embedder | None = None, task_bytes: int = TASK_BYTES) -> None:
    """Adds the documents of a batch (name, source, text, fragments) that the index does not hold.

    With language ``profiles`` the ``uri`` ends in the language of the text.
    """
    spark = batch.sparkSession
    docs = batch.dropDuplicates(["name"])
    docs = docs.withColumn("lang", F.lit(None).cast("string"))
    if profiles is not None:
        docs = with_language(docs, profiles, profiles.count()) or docs
    docs = docs.withColumn("uri", make_uri(F.col("name"), F.col("lang")))
    # Read twice (how much there is, then the rows): the batch's files are not read again for it.
    docs = docs.persist()
    try:
        size = docs.agg(F.sum(F.octet_length("text"))).first()
        with index_lock(spark, index_path, owner):
            count = open_index(spark, index_path, index_fragments(docs, dim, max_tokens, embedder).schema, shards)
            new = docs.join(stored_names(spark, index_path, docs), "name", "left_anti")
            # A document is written by one task into one file, so its rows become visible together; a shard is
            # dealt to as many tasks as the batch's bytes ask for.
            salts = max(1, -(-int(size[0] or 0) // (count * task_bytes)))
            whole = (with_shard(new, count).withColumn("_salt", F.pmod(F.hash("name"), F.lit(salts)))
                     .repartition(count * salts, "shard", "_salt").drop("_salt"))
            columns = stored_rows(spark, index_path).columns
            (index_fragments(whole, dim, max_tokens, embedder).select(*columns).write.mode("append")
             .option("maxRecordsPerFile", 0).partitionBy("shard").parquet(index_path))
    finally:
        docs.unpersist()


def ingest_stream(spark: SparkSession, source_dir: str | list[str], index_path: str, checkpoint: str,
                  dim: int, available_now: bool = True, shards: int | None = None,
                  files_per_batch: int | None = None, bytes_per_batch: str | None = None, **settings):
    """D1. Index each new text file's content once; returns the started query.

    ``source_dir`` is a folder or a list of folders that one query reads together.
    ``files_per_batch`` and ``bytes_per_batch`` (such as "1g") bound what a micro-batch
    takes of each folder, so that a backlog is worked off in steps.  ``settings``
    go to ``ingest_batch``.
    """
    limits = {k: v for k, v in (("maxFilesPerTrigger", files_per_batch), ("maxBytesPerTrigger", bytes_per_batch)) if v}

    def folder(path: str) -> DataFrame:
        stream = (spark.readStream.format("text").option("wholetext", True).options(**limits)
                  .schema(TEXT_FILE_SCHEMA).load(path))
        return documents_from_files(stream)

    folders = [source_dir] if isinstance(source_dir, str) else list(source_dir)
    docs = reduce(DataFrame.unionByName, [folder(f) for f in folders])
    writer = (docs.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, _: ingest_batch(df, index_path, dim, shards, owner=checkpoint, **settings)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def ingest_report(index: DataFrame, model: str = DEFAULT_EMBEDDING_MODEL) -> DataFrame:
    """(name, uri, batch, tokens, fragments, cost): what embedding each stored document's batches took."""
    per_batch = index.groupBy("name", "uri", "batch").agg(
        F.sum("n_tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).cast("bigint").alias("fragments"))
    _, embedding_models = model_catalog(index.sparkSession)
    costs = embedding_cost(per_batch, embedding_models, model).select("name", "batch", "cost")
    return per_batch.join(costs, ["name", "batch"]).select("name", "uri", "batch", "tokens", "fragments", "cost")
