"""SIF weights, centroids and central fragments on document rows.

A document is a row of arrays (fragments, their terms, their vectors), so its
document frequencies, weights, centroid, scores and ranking are folds over its
own arrays and nothing moves.  A document with more than ``slice_rows`` fragments
is several rows, slices of consecutive fragments; only for these are small
partial results brought together: (name, term, df), one weight for each
fragment, one sum vector for each slice, and the best fragments of each slice.
The slices themselves, with text and vectors, stay where they are as long as
what comes back to them is below the broadcast bound.

The operators on fragment tables (``operators.summary``) give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweave.constants import RANK_DECIMALS, SIF_ALPHA, SUMMARY_CANDIDATES
from docweave.functions.arrow import as_lists, by_pieces, coded, lengths
from docweave.functions.hashing import (
    TermCodes, filled, hashed_lists, hashed_vector, run_lengths, run_starts, unit_lists,
)
from docweave.functions.text import TERM_LETTERS, clean_lines, spaced_terms, terms, token_count, words
from docweave.functions.vectors import cosine, exploded, let, norm, vmax
from docweave.operators.fragments import label_paragraph
from docweave.operators.summary import summary_method
from docweave.plans.sizing import materialize, maybe_broadcast

# Components of a slice's vectors at most, so that a row stays small.
SLICE_COMPONENTS = 4 << 20


def slice_rows_of(dim: int) -> int:
    return max(1, SLICE_COMPONENTS // dim)


def document_rows(docs: DataFrame, dim: int, text_col: str = "text", name_col: str = "name",
                  keep: tuple[str, ...] = ("lang",), slice_rows: int | None = None,
                  embed: Callable[[Column, int], Column] = hashed_vector, alpha: float | None = None) -> DataFrame:
    """(name, *keep, n_fragments, slice, texts, terms, embeddings[, weights]): documents in slices of ``slice_rows`` fragments.

    Row-wise.  ``embed(terms, dim)`` gives a fragment's vector from its terms; the
    hashed vectors, the default, are counted by numpy.  With ``alpha`` the same pass
    makes the SIF weights of documents of one row, which need no ``terms`` (null) then.
    A document without fragments has no row.
    """
    rows = slice_rows or slice_rows_of(dim)

    def slices(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / rows).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
            F.size(lines).cast("bigint").alias("n_fragments"), k.alias("slice"),
            F.slice(lines, k * rows + 1, F.lit(rows)).alias("texts")))
        return F.when(F.size(lines) > 0, cut)

    cut = exploded(docs, let(clean_lines(F.col(text_col)), slices), "_k", "_s", F.col(name_col).alias("name"), *keep)
    cut = cut.select("name", *keep, "_s.*")
    with_terms = cut.withColumn("terms", F.transform("texts", terms))
    if embed is hashed_vector:
        schema = T.StructType([*with_terms.schema.fields, T.StructField("embeddings", T.ArrayType(T.ArrayType(T.FloatType())))])
        if alpha is None:
            vectors = hashed_lists(dim)
            return by_pieces(with_terms, lambda part: [*part.columns, vectors(part.column("terms"))], schema)
        # A fragment's terms come as one string: a list of strings takes the JVM and Arrow several times as long.
        spaced, known = cut.withColumn("terms", F.transform("texts", spaced_terms)), TermCodes(dim)

        def made(part: pa.RecordBatch) -> list:
            sizes = lengths(part.column("texts"))
            spoken = [[w for w in text.split() if len(w) >= TERM_LETTERS]
                      for text in part.column("terms").flatten().to_pylist()]
            counts = np.fromiter(map(len, spoken), np.int64, len(spoken))
            codes = known.of_piece(chain.from_iterable(spoken), int(counts.sum()))
            weights, whole = _whole_weights(part, alpha, counts, codes, known)
            rest = _rest_of_terms(whole, sizes, spoken, schema["terms"].dataType)
            return [*part.columns[:-1], rest, unit_lists(known.table[codes], counts, sizes, dim), weights]

        return by_pieces(spaced, made, schema.add("weights", T.ArrayType(T.DoubleType())))
    found = with_terms.withColumn("embeddings", F.transform("terms", lambda t: embed(t, dim)))
    return found if alpha is None else _with_weights(found, alpha)


def _sliced(rows: DataFrame) -> bool:
    """Whether any document is more than one row (one column of the stored rows is read)."""
    return bool(rows.filter(F.col("slice") > 0).select("slice").take(1))


def _by_document(rows: DataFrame, row_wise: Callable[[DataFrame], DataFrame],
                 merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``row_wise`` of the documents that are one row, with ``merged`` of the others if there are any."""
    if not _sliced(rows):
        return row_wise(rows)
    whole = F.col("n_fragments") == F.size("texts")
    return row_wise(rows.filter(whole)).unionByName(merged(rows.filter(~whole)))


def term_frequencies(fragment_terms: Column) -> Column:
    """ARRAY<STRUCT<term, df>>: in how many of the fragments each term occurs."""
    def counted(ordered: Column) -> Column:
        return let(run_starts(ordered), lambda starts: F.zip_with(
            F.transform(starts, lambda s: F.get(ordered, s)), run_lengths(starts, F.size(ordered)),
            lambda t, n: F.struct(t.alias("term"), n.cast("bigint").alias("df"))))

    return let(F.sort_array(F.flatten(F.transform(fragment_terms, F.array_distinct))), counted)


def idf_of(n: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1.0


def _share(n: Column, df: Column, alpha: float) -> Column:
    return F.lit(alpha) / (F.lit(alpha) + idf_of(n, df))


def _rest_of_terms(whole: np.ndarray, sizes: np.ndarray, spoken: list[list[str]], kind: T.DataType) -> pa.Array:
    """The terms of rows that are not ``whole``, null for the others."""
    ends = np.cumsum(sizes)
    return pa.array([None if w else spoken[end - n:end] for w, n, end in zip(whole, sizes, ends)], to_arrow_type(kind))


def _whole_weights(part: pa.RecordBatch, alpha: float, counts: np.ndarray, codes: np.ndarray,
                   code: dict[str, int]) -> tuple[pa.Array, np.ndarray]:
    """(weights, whole) of document rows, see ``sif_weights``: no weights for those that are not ``whole`` documents.

    ``counts`` and ``codes``: how many terms each fragment has, and all of them; ``code``
    may hold others.  ``str.split`` cuts exactly where ``functions.text.words`` does.
    """
    sizes, n = lengths(part.column("texts")), part.column("n_fragments").to_numpy(zero_copy_only=False)
    kinds, row = max(1, len(code)), np.repeat(np.arange(part.num_rows), sizes)
    # Every term of a fragment once, then every term of a document with its fragments.
    once = np.unique(np.repeat(np.arange(len(row)), counts) * kinds + codes)
    terms_of, df = np.unique(row[once // kinds] * kinds + once % kinds, return_counts=True)
    shares = alpha / (alpha + np.log((1.0 + n[terms_of // kinds]) / (1.0 + df)) + 1.0)
    spoken = [text.split() for text in part.column("texts").flatten().to_pylist()]
    at = np.fromiter(map(code.get, chain.from_iterable(spoken), repeat(-1)), np.int64)
    text = np.repeat(np.arange(len(row)), [len(w) for w in spoken])[at >= 0]
    at = row[text] * kinds + at[at >= 0]
    found = np.searchsorted(terms_of, at)
    met = np.append(terms_of, -1)[found] == at
    weights = np.bincount(text[met], shares[found[met]], minlength=len(row)).astype(np.float64)
    whole = n == sizes
    return as_lists(pa.array(weights[whole[row]]), np.where(whole, sizes, 0)), whole


def _with_weights(rows: DataFrame, alpha: float) -> DataFrame:
    """``rows`` with ``weights`` of whole documents, whose ``terms`` are then null."""
    schema = T.StructType([*rows.schema.fields, T.StructField("weights", T.ArrayType(T.DoubleType()))])
    at = rows.columns.index("terms")

    def weighed(part: pa.RecordBatch) -> list:
        of_texts = part.column("terms").flatten()
        codes, values = coded(of_texts.flatten())
        weights, whole = _whole_weights(part, alpha, lengths(of_texts), codes, {t: k for k, t in enumerate(values)})
        rest = pa.nulls(part.num_rows, part.column("terms").type) if whole.all() else pa.array(
            [None if w else t for w, t in zip(whole, part.column("terms").to_pylist())], part.column("terms").type)
        return [*[rest if k == at else c for k, c in enumerate(part.columns)], weights]

    return by_pieces(rows, weighed, schema)


def sif_weights(rows: DataFrame, alpha: float = SIF_ALPHA) -> DataFrame:
    """A4. ``rows`` with ``weights``, one for each fragment (see ``operators.summary.sif_weight``), without ``terms``.

    Documents of one row have theirs from ``document_rows`` if it made them (with the
    same ``alpha``), else they are stored with them here.
    """
    def row_wise(part: DataFrame) -> DataFrame:
        if "weights" not in part.columns:
            part = materialize(_with_weights(part, alpha), "weighted-rows")
        return part.drop("terms")

    def merged(part: DataFrame) -> DataFrame:
        part = part.drop("weights")
        found = (exploded(part, term_frequencies(F.col("terms")), "i", "e", "name", "n_fragments")
                 .groupBy("name", "n_fragments", "e.term").agg(F.sum("e.df").alias("df")))
        shares = found.select("name", "term", _share(F.col("n_fragments"), F.col("df"), alpha).alias("share"))
        spots = exploded(exploded(part, F.col("texts"), "at", "text", "name", "slice"),
                         words(F.col("text")), "i", "term", "name", "slice", "at")
        sums = spots.join(shares, ["name", "term"]).groupBy("name", "slice", "at").agg(F.sum("share").alias("w"))
        lists = sums.groupBy("name", "slice").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("_w"))
        # A weight takes 16 bytes where its fragment's vector takes hundreds: broadcast unless too many.
        bound = part.select(F.sum(F.size("texts"))).first()[0] or 0
        back = part.join(maybe_broadcast(lists, bound, 16), ["name", "slice"], "left")
        found = F.coalesce("_w", F.array().cast("array<struct<at:int,w:double>>"))
        return back.withColumn("weights", filled(
            F.transform(found, lambda x: x["at"]), F.transform(found, lambda x: x["w"]), F.size("texts"),
            F.lit(0.0))).drop("_w", "terms")

    return _by_document(rows, row_wise, merged)


def _vector_sum(vectors: Column, factors: Column) -> Column:
    """Sum of the vectors, each times its factor; null without vectors."""
    pairs = F.filter(F.arrays_zip(vectors.alias("v"), factors.alias("k")), lambda p: p["v"].isNotNull())

    def total(found: Column) -> Column:
        zeros = F.transform(F.get(found, F.lit(0))["v"], lambda x: F.lit(0.0))
        return F.aggregate(found, zeros, lambda acc, p: F.zip_with(
            acc, p["v"], lambda a, x: a + x.cast("double") * p["k"]))

    return let(pairs, total)


def _factors(weights: Column, vectors: Column) -> Column:
    """What the SIF centroid multiplies each vector by: (1 - weight) / largest component, 0 where that is 0."""
    return F.zip_with(vectors, weights, lambda v, w: F.coalesce(F.try_divide(F.lit(1.0) - w, vmax(v)), F.lit(0.0)))


def with_centroids(rows: DataFrame, factors: Column) -> DataFrame:
    """A1, A5. ``rows`` with ``centroid``: the mean of the document's vectors, each times its factor."""
    part_sum = _vector_sum(F.col("embeddings"), factors)
    count = F.size(F.filter("embeddings", lambda v: v.isNotNull()))

    def row_wise(part: DataFrame) -> DataFrame:
        return part.withColumn("centroid", let(F.struct(part_sum.alias("s"), count.alias("n")), lambda m: F.transform(
            m["s"], lambda x: x / m["n"])))

    def merged(part: DataFrame) -> DataFrame:
        sums = part.select("name", part_sum.alias("s"), count.alias("n")).filter(F.col("n") > 0)
        whole = sums.groupBy("name").agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n"))
        found = whole.select("name", F.transform(vector_to_array("s"), lambda x: x / F.col("n")).alias("centroid"))
        size = part.select(F.count(F.lit(1)), F.max(F.size(F.get("embeddings", F.lit(0))))).first()
        return part.join(maybe_broadcast(found, size[0], 8 * (size[1] or 0) + 96), "name", "left")

    return _by_document(rows, row_wise, merged)


def document_centroids(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``weights`` and ``method``) with the centroid of their method: SIF, or the plain mean."""
    ones = F.transform("embeddings", lambda v: F.lit(1.0))
    return with_centroids(rows, F.when(F.col("method") == "mean", ones).otherwise(
        _factors(F.col("weights"), F.col("embeddings"))))


def sif_centroids(rows: DataFrame) -> DataFrame:
    """A5 on ``rows`` with ``weights``."""
    return with_centroids(rows, _factors(F.col("weights"), F.col("embeddings")))


def fragment_scores(centroid: Column, vectors: Column) -> Column:
    """A6. ARRAY<DOUBLE>: cosine of each vector with the centroid."""
    return let(norm(centroid), lambda n: F.transform(
        vectors, lambda v: F.round(cosine(v, centroid, None, n), RANK_DECIMALS)))


def central(rows: DataFrame, num_candidates: int = SUMMARY_CANDIDATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A7. (name, *keep, best): of each document the fragments (pos, score, text) closest to its centroid, in order.

    A null score comes last, the earlier fragment first in a tie.
    """
    def ranked(items: Column) -> Column:
        return F.slice(F.sort_array(items), F.lit(1), F.lit(num_candidates))

    def slice_best(first: Column) -> Column:
        scores = fragment_scores(F.col("centroid"), F.col("embeddings"))
        items = F.transform(F.arrays_zip(scores.alias("s"), F.col("texts").alias("t")), lambda x, i: F.struct(
            F.coalesce(-x["s"], F.lit(float("inf"))).alias("low"), (first + i).cast("bigint").alias("pos"),
            x["s"].alias("score"), x["t"].alias("text")))
        return ranked(items)

    def named(items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(x["pos"].alias("pos"), x["score"].alias("score"),
                                                     x["text"].alias("text")))

    def row_wise(part: DataFrame) -> DataFrame:
        return part.select("name", *keep, named(slice_best(F.lit(0))).alias("best"))

    def merged(part: DataFrame) -> DataFrame:
        # All slices of a document but its last hold the same number of fragments.
        full = part.filter(F.col("slice") == 0).select("name", F.size("texts").alias("_full"))
        bound = full.count()
        placed = part.join(maybe_broadcast(full, bound, 96), "name")
        per_slice = placed.select("name", *keep, slice_best(F.col("slice") * F.col("_full")).alias("b"))
        return per_slice.groupBy("name", *keep).agg(F.flatten(F.collect_list("b")).alias("b")).select(
            "name", *keep, named(ranked(F.col("b"))).alias("best"))

    return _by_document(rows, row_wise, merged)


BEST = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("text", T.StringType())]))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``a`` and ``b``, added up in the order of ``functions.vectors.dot``."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _best_of_whole(part: pa.RecordBatch, num_candidates: int) -> pa.Array:
    """``best`` of whole documents (see ``central``) from their ``method``, ``weights`` and ``embeddings``."""
    sizes, vectors = lengths(part.column("texts")), part.column("embeddings").flatten()
    row, there = np.repeat(np.arange(part.num_rows), sizes), vectors.is_valid().to_numpy(zero_copy_only=False)
    wide = lengths(vectors)[there]
    dim = int(wide.max(initial=0))
    if (wide != dim).any():
        raise ValueError("the vectors of documents need one length")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(wide), dim)
    own = row[there]
    weight = part.column("weights").flatten().to_numpy(zero_copy_only=False)[there]
    largest = v.max(axis=1, initial=-np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(largest != 0, (1.0 - weight) / largest, 0.0)
        mean = pc.fill_null(pc.equal(part.column("method"), "mean"), False).to_numpy(zero_copy_only=False)
        factor[mean[own]] = 1.0
        cells = (own[:, None] * dim + np.arange(dim)).reshape(-1)
        sums = np.bincount(cells, (v * factor[:, None]).reshape(-1), minlength=part.num_rows * dim)
        centroid = sums.reshape(part.num_rows, dim) / np.bincount(own, minlength=part.num_rows)[:, None]
        lengths_of = np.sqrt(_dots(v, v)) * np.sqrt(_dots(centroid, centroid))[own]
        found = np.where(lengths_of != 0, np.round(_dots(v, centroid[own]) / lengths_of, RANK_DECIMALS), np.nan)
    score = np.full(len(row), np.nan)
    score[there] = found
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((pos, np.where(np.isnan(score), np.inf, -score), row))
    order = order[pos < num_candidates]  # ``order`` keeps rows together, so ``pos`` is the rank there
    best = pa.StructArray.from_arrays(
        [pa.array(pos[order]), pa.array(score[order], mask=np.isnan(score[order])),
         part.column("texts").flatten().take(pa.array(order))], names=["pos", "score", "text"])
    return as_lists(best, np.minimum(sizes, num_candidates))


def central_by_method(rows: DataFrame, num_candidates: int = SUMMARY_CANDIDATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``central`` of the ``document_centroids`` of ``rows``, where whole documents are worked out by numpy, and stored."""
    def row_wise(part: DataFrame) -> DataFrame:
        own = part.select("name", *keep, F.col("method").alias("method_"), "texts", "weights", "embeddings")
        schema = T.StructType([*own.schema.fields[:len(keep) + 1], T.StructField("best", BEST)])
        names = schema.names[:-1]

        def ranked(piece: pa.RecordBatch) -> list:
            whole = pa.RecordBatch.from_arrays(piece.columns[-4:], names=["method", "texts", "weights", "embeddings"])
            return [*[piece.column(c) for c in names], _best_of_whole(whole, num_candidates)]

        return materialize(by_pieces(own, ranked, schema), "best-fragments")

    return _by_document(rows, row_wise, lambda part: central(document_centroids(part), num_candidates, keep))


def summary_rows(rows: DataFrame, budget: int, num_candidates: int = SUMMARY_CANDIDATES) -> DataFrame:
    """A8. (name, method, n_fragments, context) of stored ``document_rows`` with a ``lang``.

    Method by language, weights, centroid, candidates, labels, the budget's cut and
    the numbered list, all on the document's row.
    """
    routed = rows.withColumn("method", summary_method(F.col("lang")))
    best = central_by_method(sif_weights(routed), num_candidates, keep=("method",))

    def cut(items: Column) -> Column:
        """The labels whose earlier ones fit the budget; the one that overflows is the last."""
        labels = F.transform(items, lambda x: label_paragraph(x["pos"], x["text"]))

        def kept(found: Column) -> Column:
            state = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("n"))
            n = F.aggregate(found, state, lambda acc, x: F.struct(
                (acc["run"] + token_count(x)).alias("run"),
                (acc["n"] + F.when(acc["run"] <= budget, 1).otherwise(0)).alias("n")), lambda acc: acc["n"])
            # A token has a character at least: labels with no more characters than the budget all stay, uncounted.
            short = F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)) <= budget
            return F.when(short, found).otherwise(F.slice(found, F.lit(1), n))

        return let(labels, kept)

    return best.select("name", "method", cut(F.col("best")).alias("_l")).select(
        "name", "method", F.size("_l").cast("bigint").alias("n_fragments"),
        F.array_join(F.transform("_l", lambda x, i: F.concat(i.cast("string"), F.lit(". "), x)), "\n")
        .alias("context"))
