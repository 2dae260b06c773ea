"""Embedding.

The built-in embedder is feature hashing, evaluated row-wise inside the JVM.
A caller-supplied embedder (a model client, say) runs through
``groupBy(name, batch).applyInPandas``: each call receives exactly one packed
batch, whose size the packer bounds by the model's token limit, and vectors
are matched to fragments by ``pos``, never by row order.
"""

from __future__ import annotations

from itertools import chain
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.hashing import hashed_vector
from docweave.functions.text import terms, token_count


def hashing_embedder(df: DataFrame, dim: int, text_col: str = "text",
                     out: str = "embedding", keep_terms: bool = False) -> DataFrame:
    """E3. Unit-length hashed term counts of ``text_col`` as ARRAY<FLOAT>(dim).

    With ``keep_terms`` the term array is kept as ``terms`` so vocabulary
    steps reading a stored index do not re-run the term regex.
    """
    if not keep_terms:
        return df.withColumn(out, hashed_vector(terms(F.col(text_col)), dim))
    with_terms = df.withColumn("terms", terms(F.col(text_col)))
    return with_terms.withColumn(out, hashed_vector(F.col("terms"), dim))


Embedder = Callable[[list[str]], list[list[float]]]

# Batches whose vectors go back to Spark together: a frame for each would cost more than its vectors.
FRAME_BATCHES = 64
# Terms whose bucket the caller-side embedder remembers.
KNOWN_TERMS = 1 << 17


def checked(vectors: list, rows: int, dim: int) -> list:
    """The vectors, if there is one of length ``dim`` for each row; else an error that fails the task."""
    if len(vectors) != rows or any(len(v) != dim for v in vectors):
        raise ValueError(f"the embedder must return {rows} vectors of length {dim}")
    return vectors


def embed_fragments(packed: DataFrame, dim: int, embedder: Embedder | None = None,
                    text_col: str = "text") -> DataFrame:
    """E1. One vector per fragment.

    ``embedder=None`` uses the native hashing embedder.  Otherwise
    ``embedder(texts) -> vectors`` is called once per (name, batch) group and
    must return a vector of length ``dim`` for every text.
    """
    if embedder is None:
        return hashing_embedder(packed, dim, text_col)
    fields = [f for f in packed.schema.fields]
    out_schema = T.StructType(fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        vectors = checked(embedder(pdf[text_col].tolist()), len(pdf), dim)
        pdf = pdf.copy()
        pdf["embedding"] = [np.asarray(v, dtype=np.float32) for v in vectors]
        return pdf

    return packed.groupBy("name", "batch").applyInPandas(run, schema=out_schema)


def embed_batches(batches: DataFrame, dim: int, embedder: Embedder, keep: tuple[str, ...] = (),
                  with_tokens: bool = False) -> DataFrame:
    """E1 on batch rows (name, *keep, batch, first, texts): (name, *keep, pos, text, batch, embedding), without a shuffle.

    ``embedder(texts) -> vectors`` is called once per row, where the row is.
    ``with_tokens`` adds the token count of each text.
    """
    schema = T.StructType([*[batches.schema[c] for c in ("name", *keep)], T.StructField("pos", T.LongType()),
                           T.StructField("text", T.StringType()), T.StructField("batch", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])
    def run(incoming):
        for whole in incoming:
            for start in range(0, whole.num_rows, FRAME_BATCHES):
                part = whole.slice(start, FRAME_BATCHES)
                texts = part.column("texts").to_pylist()
                vectors = [v for own in texts for v in checked(embedder(own), len(own), dim)]
                sizes = np.array([len(own) for own in texts])
                rows = pa.array(np.repeat(np.arange(len(texts)), sizes))
                first = np.repeat(part.column("first").to_numpy(zero_copy_only=False) - (np.cumsum(sizes) - sizes), sizes)
                flat = np.asarray(vectors, dtype=np.float32).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(rows) for c in ("name", *keep)], pa.array(first + np.arange(len(vectors))),
                     part.column("texts").flatten(), part.column("batch").take(rows),
                     pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * dim, pa.array(flat))],
                    names=schema.names)

    found = batches.select("name", *keep, "batch", "first", "texts").mapInArrow(run, schema)
    return found.withColumn("n_tokens", token_count(F.col("text"))) if with_tokens else found


def embed_query(requests: DataFrame, dim: int, embedder: Embedder | None = None,
                text_col: str = "keywords") -> DataFrame:
    """E2. One vector per request text (the keywords by default).

    Native hashing by default; a caller's ``embedder`` runs per Arrow batch
    through ``mapInPandas`` (questions are short, so no token packing).
    """
    if embedder is None:
        return hashing_embedder(requests, dim, text_col)
    out_schema = T.StructType(list(requests.schema.fields)
                              + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vectors = checked(embedder(pdf[text_col].tolist()) if len(pdf) else [], len(pdf), dim)
            pdf = pdf.copy()
            pdf["embedding"] = [np.asarray(v, dtype=np.float32) for v in vectors]
            yield pdf

    return requests.mapInPandas(run, out_schema)


def python_hashing_embedder(dim: int) -> Embedder:
    """The built-in embedder written as a caller-side function (used to test E1's hook)."""
    import hashlib

    import regex

    term_re = regex.compile(r"[\p{L}\p{N}_]{2,}")
    class Buckets(dict):
        def __missing__(self, term: str) -> int:
            if len(self) >= KNOWN_TERMS:
                self.clear()
            found = self[term] = int(hashlib.md5(term.encode("utf-8")).hexdigest()[:8], 16) % dim
            return found

    bucket = Buckets().__getitem__

    def embed(texts: list[str]) -> list[list[float]]:
        buckets = [list(map(bucket, term_re.findall(text.lower()))) for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(b) for b in buckets])
        at = rows * dim + np.fromiter(chain.from_iterable(buckets), np.int64, len(rows))
        counts = np.bincount(at, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
        n = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return (counts / np.where(n > 0, n, 1.0)).astype(np.float32).tolist()

    return embed


def check_dimension(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """E4. Flag rows whose vector length is not ``dim`` (``valid`` column)."""
    return df.withColumn("valid", F.coalesce(F.size(F.col(col)) == dim, F.lit(False)))
