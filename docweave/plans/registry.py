"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables whole.  Float outputs are rounded to 6
decimals and integer outputs are BIGINT so the DuckDB oracle can compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from docweave.constants import (
    CONSOLE_PREVIEW, DEFAULT_CHAT_MODEL, DEFAULT_DIMENSIONS, DEFAULT_EMBEDDING_MODEL, HASH_DIM,
    PACK_MAX_TOKENS, RETRIEVAL_LIMIT, SIF_ALPHA,
)
from docweave.functions.hashing import sparse_unit
from docweave.functions.text import strip_ws, terms, token_count
from docweave.functions.vectors import exploded
from docweave.operators import prompts as P
from docweave.operators.cost import chat_cost, embedding_cost, embedding_cost_totals, model_catalog
from docweave.operators.document_rows import (
    central_by_method, document_centroids, document_rows, fragment_scores, sif_centroids, sif_weights, slice_rows_of,
    summary_rows,
)
from docweave.operators.embedding import (
    check_dimension, embed_batches, hashing_embedder, python_hashing_embedder,
)
from docweave.operators.fragments import (
    fragment_arrays, label_paragraphs, numbered_document, paragraph_fragments, preview, reflow_lines,
    rejected_documents, split_fragments,
)
from docweave.operators.identity import content_id_of_text, make_uri, parse_uri
from docweave.operators.language import detect_language, language_profiles, with_language
from docweave.operators.retrieval import (
    already_indexed, dedupe_documents, fetch_fragments, new_documents, top_k_cosine,
    top_k_inner_product, unknown_documents,
)
from docweave.operators.summary import (
    document_frequency, idf, mean_vector, summary_method, vocabulary,
)
from docweave.operators.tokens import (
    batch_totals, cut_document_report, cut_documents, document_batches, pack_document_batches,
)
from docweave.plans import bindings as B
from docweave.plans.answer import answer_context, answer_hits, context_budget, dealt_keywords
from docweave.plans.by_uri import answer_by_uri, by_uri, summary_by_uri
from docweave.plans.scan import dense_positions
from docweave.plans.sizing import materialize, maybe_broadcast
from docweave.session import checkpoint_dir
from docweave.sources.files import page_documents, source_kind
from docweave.sources.html import html_fragments, page_text_with_fallback
from docweave.sources.index import append_positions, clear_index, read_index, reindex, write_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def doc_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of every document, carrying the document's language (free through the explode)."""
    return split_fragments(B.documents(spark, sf), keep=("lang",))


def requested_fragments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Questions, fragments of the documents they ask about, and a row bound on questions.

    The fragments are written once (they feed both the vocabulary and the
    vector index) and scanned back from Parquet.
    """
    req = B.requests(spark, sf)
    bound = B.row_bound(spark, sf, "conversations")
    names = maybe_broadcast(req.select("name").distinct(), bound, 16)
    docs = B.documents(spark, sf).join(names, "name", "left_semi")
    return req, asked_fragments(docs), bound


def asked_fragments(docs: DataFrame) -> DataFrame:
    """Stored fragments of the documents asked about, dealt anew: they may all lie in a few files of their table."""
    return materialize(split_fragments(docs.select("name", "text").repartition("name", "text")), "fragments")


# ---------------------------------------------------------------- fragments


@register
def q_split_fragments(spark, sf):
    return doc_fragments(spark, sf).select("name", "pos", "text")


@register
def q_content_id(spark, sf):
    docs = B.documents(spark, sf)
    return docs.select("doc_id", content_id_of_text(F.col("text")).alias("content_id"))


# ---------------------------------------------------------------- tokens


@register
def q_token_count(spark, sf):
    frags = doc_fragments(spark, sf)
    return frags.select("name", "pos", token_count(F.col("text")).alias("n_tokens"))


# ---------------------------------------------------------------- embedding


def sparse_rows(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    """Non-zero coordinates of a vector column as rows (keys..., b, v)."""
    return (exploded(df, F.col(vec), "b", "v", *keys).filter(F.col("v") != 0)
            .select(*keys, F.col("b").cast("bigint").alias("b"), F.round(F.col("v").cast("double"), 6).alias("v")))


@register
def q_hashing_embedder(spark, sf):
    return sparse_rows(hashing_embedder(doc_fragments(spark, sf), HASH_DIM), ["name", "pos"])


@register
def q_hashing_embedder_wide(spark, sf):
    """The embedder at the width of the embedding models; vectors stay sparse, so the width costs nothing."""
    vectors = doc_fragments(spark, sf).select("name", "pos", sparse_unit(terms(F.col("text")), DEFAULT_DIMENSIONS).alias("v"))
    entries = F.arrays_zip(F.col("v.index").alias("b"), F.col("v.value").alias("v"))
    return exploded(vectors, entries, "_i", "e", "name", "pos").select(
        "name", "pos", "e.b", F.round(F.col("e.v").cast("double"), 6).alias("v"))


# ---------------------------------------------------------------- pipelines


@register
def q_answer_context(spark, sf):
    req, frags, bound = requested_fragments(spark, sf)
    return answer_context(req, frags, HASH_DIM, request_rows=bound, fragment_rows=frags.count())


# ---------------------------------------------------------------- shared inputs


def conversation_fragments(spark, sf) -> DataFrame:
    """Lines of every conversation turn: (name := conv_id, turn, line, text)."""
    conv = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("name"), "turn", "text")
    return split_fragments(conv, keep=("turn",)).withColumnRenamed("pos", "line")


def labelled_names(spark, sf) -> DataFrame:
    """Documents present in ``labels``: the already-indexed set in the bindings."""
    return B.table(spark, sf, "labels").select(F.col("doc_id").alias("name"))


def doc_ids(spark, sf) -> DataFrame:
    """Fingerprint and language of every document, stored: texts are read and hashed once, whatever follows."""
    docs = B.documents(spark, sf)
    return materialize(docs.select("doc_id", "lang", content_id_of_text(F.col("text")).alias("content_id")), "doc-ids")


def sif_fragments(spark, sf) -> DataFrame:
    """The document index: fragments with hashed vectors (name, lang, pos, text, embedding),
    written once and scanned back by every later step.  Their terms are not part of the index."""
    return materialize(hashing_embedder(doc_fragments(spark, sf), HASH_DIM), "index")


def index_rows(spark, sf) -> DataFrame:
    """The document index as document rows with hashed vectors, written once and scanned back by every later step."""
    return materialize(document_rows(B.documents(spark, sf), HASH_DIM, alpha=SIF_ALPHA), "document-rows")


def detected_rows(spark, sf) -> DataFrame:
    """``index_rows`` with the language found in the text instead of the table's label."""
    prof = language_profiles(B.table(spark, sf, "documents"))
    docs, rows = B.documents(spark, sf), prof.count()
    found = with_language(docs, prof, rows)
    if found is None:  # a profile too large to be everywhere: scored through a join, then brought back by name
        langs = detect_language(docs, prof, ["name"], profile_rows=rows).select("name", "lang")
        found = docs.drop("lang").join(langs, "name")
    return materialize(document_rows(found, HASH_DIM, alpha=SIF_ALPHA), "document-rows")


def dense_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Non-zero coordinates of a vector column as rows (key, i, value)."""
    return (exploded(df, F.col(vec), "i", "value", key).filter(F.col("value") != 0)
            .select(key, F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value")))


def scratch_path(spark, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and index


@register
def q_source_kind(spark, sf):
    docs = B.table(spark, sf, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), source_kind(F.col("source")).alias("kind"))
    pages = B.table(spark, sf, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), source_kind(F.col("url")).alias("kind"))
    return docs.unionByName(pages)


@register
def q_append_positions(spark, sf):
    existing = doc_fragments(spark, sf)
    new_rows = conversation_fragments(spark, sf)
    return append_positions(existing, new_rows, ["turn", "line"]).select("name", "turn", "line", "pos", "text")


@register
def q_index_scan(spark, sf):
    path = scratch_path(spark, "index")
    write_index(sif_fragments(spark, sf), path)
    return read_index(spark, path, names=B.requests(spark, sf)).select("name", "pos", "text")


@register
def q_index_clear(spark, sf):
    toxic = B.table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("name"))
    return clear_index(doc_fragments(spark, sf), toxic).select("name", "pos", "text")


@register
def q_index_reindex(spark, sf):
    conv = conversation_fragments(spark, sf)
    new_rows = dense_positions(conv, "name", "turn", extra_order=["line"]).select("name", "pos", "text")
    return reindex(doc_fragments(spark, sf).select("name", "pos", "text"), new_rows)


# ---------------------------------------------------------------- fragments


@register
def q_reflow_lines(spark, sf):
    lines = conversation_fragments(spark, sf).select(
        "name", F.col("turn").alias("page"), F.col("line").alias("pos"), "text")
    return reflow_lines(lines)


@register
def q_html_fragments(spark, sf):
    return html_fragments(page_documents(B.table(spark, sf, "pages")), "name")


@register
def q_html_fallback(spark, sf):
    return split_fragments(page_text_with_fallback(B.table(spark, sf, "pages")))


@register
def q_paragraph_fragments(spark, sf):
    conv = B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("name"), F.col("turn").alias("pos"), "text")
    return paragraph_fragments(conv)


@register
def q_document_uri(spark, sf):
    ids = doc_ids(spark, sf).withColumn("uri", make_uri(F.col("content_id"), F.left(F.col("lang"), F.lit(2))))
    parsed_id, parsed_lang = parse_uri(F.col("uri"))
    return ids.select("doc_id", "uri", parsed_id.alias("uri_id"), parsed_lang.alias("uri_lang"))


@register
def q_rejected_documents(spark, sf):
    docs = rejected_documents(B.table(spark, sf, "documents")).select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"))
    pages = B.table(spark, sf, "pages")
    frags = html_fragments(pages)
    empty_pages = rejected_documents(pages, frags, name_col="page_id").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"))
    return docs.unionByName(empty_pages)


@register
def q_label_paragraphs(spark, sf):
    return label_paragraphs(doc_fragments(spark, sf)).select("name", "pos", "label")


@register
def q_numbered_list(spark, sf):
    return numbered_document(fragment_arrays(B.documents(spark, sf)))


@register
def q_context_preview(spark, sf):
    req, frags, bound = requested_fragments(spark, sf)
    _, hits = answer_hits(req, frags, HASH_DIM, request_rows=bound, fragment_rows=frags.count())
    return preview(hits, "request_id", ["rank"], CONSOLE_PREVIEW).select("request_id", "rank", "label")


@register
def q_clean_queries(spark, sf):
    return P.clean_queries(B.raw_requests(spark, sf))


@register
def q_language_profiles(spark, sf):
    prof = language_profiles(B.table(spark, sf, "documents"))
    return prof.select("lang", "gram", F.round("logp", 6).alias("logp"), F.round("unseen", 6).alias("unseen"),
                       F.round("prior", 6).alias("prior"))


@register
def q_detect_language(spark, sf):
    prof = language_profiles(B.table(spark, sf, "documents"))   # fit: counts stored once
    turns = B.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return detect_language(turns, prof, ["conv_id", "turn"], profile_rows=prof.count()).select(
        "conv_id", "turn", "lang")


@register
def q_detected_documents(spark, sf):
    """Language, summary method and URI of every document from its text alone (no label needed)."""
    prof = language_profiles(B.table(spark, sf, "documents"))
    docs = B.table(spark, sf, "documents")
    found = detect_language(docs.select("doc_id", "text"), prof, ["doc_id"], profile_rows=prof.count())
    ids = docs.select("doc_id", content_id_of_text(F.col("text")).alias("content_id"))
    return ids.join(found, "doc_id").select(
        "doc_id", "lang", summary_method(F.col("lang")).alias("method"),
        make_uri(F.col("content_id"), F.col("lang")).alias("uri"))


@register
def q_summary_method(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "lang", summary_method(F.col("lang")).alias("method"))


@register
def q_split_keywords(spark, sf):
    req, frags, _ = requested_fragments(spark, sf)
    kw = dealt_keywords(req, frags, frags.count()).filter("keywords <> ''")
    return exploded(kw, P.split_keywords(F.col("keywords")), "idx", "keyword", "request_id").withColumn(
        "idx", F.col("idx").cast("bigint"))


# ---------------------------------------------------------------- tokens, batches, cost


def packed_documents(spark, sf) -> DataFrame:
    return pack_document_batches(fragment_arrays(B.documents(spark, sf)), PACK_MAX_TOKENS)


@register
def q_pack_batches(spark, sf):
    return packed_documents(spark, sf).select("name", "pos", "n_tokens", "batch")


@register
def q_batch_totals(spark, sf):
    return batch_totals(packed_documents(spark, sf)).select(
        "name", "batch", F.col("level").cast("bigint").alias("level"), "tokens", "fragments")


@register
def q_cut_to_budget(spark, sf):
    return cut_documents(fragment_arrays(B.documents(spark, sf)), context_budget())


@register
def q_cut_report(spark, sf):
    return cut_document_report(fragment_arrays(B.documents(spark, sf)), context_budget())


@register
def q_chat_cost(spark, sf):
    conv = B.table(spark, sf, "conversations").withColumn("_t", token_count(F.col("text")))
    usage = conv.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role").isin("user", "system"), F.col("_t")).otherwise(0)).cast("bigint")
        .alias("prompt_tokens"),
        F.sum(F.when(F.col("role") == "assistant", F.col("_t")).otherwise(0)).cast("bigint")
        .alias("completion_tokens"))
    chat_models, _ = model_catalog(spark)
    return chat_cost(usage, chat_models, model=DEFAULT_CHAT_MODEL)


@register
def q_embedding_cost(spark, sf):
    per_batch = packed_documents(spark, sf).groupBy("name", "batch").agg(
        F.sum("n_tokens").cast("bigint").alias("tokens"))
    _, embedding_models = model_catalog(spark)
    return embedding_cost(per_batch, embedding_models, DEFAULT_EMBEDDING_MODEL)


@register
def q_embedding_cost_totals(spark, sf):
    return embedding_cost_totals(q_embedding_cost(spark, sf))


# ---------------------------------------------------------------- embedding


@register
def q_embed_fragments(spark, sf):
    batches = document_batches(fragment_arrays(B.documents(spark, sf)), PACK_MAX_TOKENS)
    vectors = embed_batches(batches, HASH_DIM, python_hashing_embedder(HASH_DIM))
    return sparse_rows(vectors, ["name", "pos"])


@register
def q_check_dimension(spark, sf):
    vec = B.table(spark, sf, "embeddings")
    return check_dimension(vec, HASH_DIM).select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"), "valid")


# ---------------------------------------------------------------- retrieval


def question_hits(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """Hits of every question, the stored fragments of the documents asked about, and a row bound on questions."""
    req, frags, bound = requested_fragments(spark, sf)
    queries = hashing_embedder(req, HASH_DIM, text_col="query").select("request_id", "name", "embedding")
    hits = top_k_inner_product(queries, hashing_embedder(frags, HASH_DIM), query_rows=bound, dim=HASH_DIM)
    return hits, frags, bound


@register
def q_top_k_inner_product(spark, sf):
    hits, _, _ = question_hits(spark, sf)
    return hits.select("request_id", "rank", "pos", F.round("score", 6).alias("score"))


@register
def q_top_k_cosine(spark, sf):
    vec = B.vectors(spark, sf)
    cents = materialize(mean_vector(vec).select(F.col("name").alias("request_id"), "name",
                                                F.col("centroid").alias("embedding")), "centroids")
    labels = cents.count()
    hits = top_k_cosine(cents, vec, query_rows=labels, dim=HASH_DIM)
    return hits.select("request_id", "rank", "pos", F.round("distance", 6).alias("distance"))


@register
def q_fetch_fragments(spark, sf):
    hits, frags, bound = question_hits(spark, sf)
    found = fetch_fragments(hits.select("request_id", "name", "rank", "pos"), frags, bound * RETRIEVAL_LIMIT)
    return found.select("request_id", "rank", "pos", "text")


@register
def q_already_indexed(spark, sf):
    ids = doc_ids(spark, sf)
    index_names = ids.join(labelled_names(spark, sf).withColumnRenamed("name", "doc_id"), "doc_id", "left_semi") \
        .select(F.col("content_id").alias("name"))
    return already_indexed(ids, index_names).select("doc_id", "content_id")


@register
def q_new_documents(spark, sf):
    ids = doc_ids(spark, sf)
    index_names = ids.join(labelled_names(spark, sf).withColumnRenamed("name", "doc_id"), "doc_id", "left_semi") \
        .select(F.col("content_id").alias("name"))
    return new_documents(ids.select("content_id", "doc_id"), index_names).select("content_id", "doc_id")


@register
def q_unknown_documents(spark, sf):
    docs = B.documents(spark, sf).join(labelled_names(spark, sf), "name", "left_semi")
    held = docs.filter(strip_ws(F.col("text")) != "").select("name")  # a document is indexed if it has a fragment
    return unknown_documents(B.requests(spark, sf), held).select("request_id", "name")


@register
def q_extract_keywords(spark, sf):
    req, frags, _ = requested_fragments(spark, sf)
    return dealt_keywords(req, frags, frags.count())


# ---------------------------------------------------------------- aggregation and summary


@register
def q_mean_vector(spark, sf):
    return dense_rows(mean_vector(B.vectors(spark, sf)), "name", "centroid")


@register
def q_document_frequency(spark, sf):
    return document_frequency(doc_fragments(spark, sf)).select("name", "term", "df")


@register
def q_idf(spark, sf):
    frags = doc_fragments(spark, sf)
    bound = B.row_bound(spark, sf, "documents")
    return idf(document_frequency(frags), frags, bound).select("name", "term", F.round("idf", 6).alias("idf"))


@register
def q_sif_weight(spark, sf):
    weights = sif_weights(index_rows(spark, sf))
    first = F.col("slice") * slice_rows_of(HASH_DIM)
    return exploded(weights, F.col("weights"), "at", "weight", "name", first.alias("first")).select(
        "name", (F.col("first") + F.col("at")).cast("bigint").alias("pos"), F.round("weight", 9).alias("weight"))


@register
def q_sif_mean_vector(spark, sf):
    found = sif_centroids(sif_weights(index_rows(spark, sf)))
    return dense_rows(found.filter("slice = 0").select("name", "centroid"), "name", "centroid")


def routed_centroids(spark, sf) -> DataFrame:
    routed = index_rows(spark, sf).withColumn("method", summary_method(F.col("lang")))
    return document_centroids(sif_weights(routed))


@register
def q_centrality(spark, sf):
    rows = routed_centroids(spark, sf)
    scores = fragment_scores(F.col("centroid"), F.col("embeddings"))
    first = F.col("slice") * slice_rows_of(HASH_DIM)
    return exploded(rows, scores, "at", "score", "name", first.alias("first")).select(
        "name", (F.col("first") + F.col("at")).cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


@register
def q_central_fragments(spark, sf):
    routed = index_rows(spark, sf).withColumn("method", summary_method(F.col("lang")))
    best = central_by_method(sif_weights(routed), 3)
    return exploded(best, F.col("best"), "rank", "b", "name").select(
        "name", F.col("rank").cast("bigint").alias("rank"), "b.pos", F.round("b.score", 6).alias("score"))


def document_summaries(spark, sf) -> DataFrame:
    """Summary context of every document, routed by the language found in its text."""
    return summary_rows(detected_rows(spark, sf), context_budget())


@register
def q_summary_context(spark, sf):
    return document_summaries(spark, sf)


def indexed_contents(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(uris, docs): the URI of every document by its text, and one document for each content, named by it."""
    prof = language_profiles(B.table(spark, sf, "documents"))
    docs = B.documents(spark, sf).withColumn("content_id", content_id_of_text(F.col("text")))
    found = detect_language(docs.select("doc_id", "text"), prof, ["doc_id"], profile_rows=prof.count())
    uris = materialize(docs.select("doc_id", "content_id").join(found.select("doc_id", "lang"), "doc_id").withColumn(
        "uri", make_uri(F.col("content_id"), F.col("lang"))), "uris")
    first = dedupe_documents(uris.select("content_id", "doc_id")).select("doc_id")
    kept = docs.join(maybe_broadcast(first, B.row_bound(spark, sf, "documents"), 16), "doc_id", "left_semi")
    return uris, kept.select(F.col("content_id").alias("name"), "text")


@register
def q_answer_by_uri(spark, sf):
    """Every question, asked of the URI of its document; one about a document that is not there has none."""
    uris, docs = indexed_contents(spark, sf)
    bound = B.row_bound(spark, sf, "conversations")
    asked = materialize(B.requests(spark, sf).join(uris.select(F.col("doc_id").alias("name"), "uri"), "name", "left")
                        .select("request_id", "uri", "query"), "uri-requests")
    names = maybe_broadcast(by_uri(asked).select("name").distinct(), bound, 48)
    frags = asked_fragments(docs.join(names, "name", "left_semi"))
    return answer_by_uri(asked, frags, HASH_DIM, request_rows=bound, fragment_rows=frags.count())


@register
def q_summary_by_uri(spark, sf):
    """A summary for the URI of every document, made once for each content."""
    uris, docs = indexed_contents(spark, sf)
    rows = materialize(document_rows(docs, HASH_DIM, keep=(), alpha=SIF_ALPHA), "document-rows")
    return summary_by_uri(uris.select(F.col("doc_id").alias("request_id"), "uri"), rows.withColumn("lang", F.lit(None)),
                          request_rows=B.row_bound(spark, sf, "documents"))


@register
def q_vocabulary(spark, sf):
    return vocabulary(doc_fragments(spark, sf))


# ---------------------------------------------------------------- prompts and chat


@register
def q_answer_prompts(spark, sf):
    req, frags, bound = requested_fragments(spark, sf)
    ctx = answer_context(req, frags, HASH_DIM, request_rows=bound, fragment_rows=frags.count())
    return P.explode_messages(P.answer_prompts(ctx, req), "request_id")


@register
def q_summary_prompts(spark, sf):
    return P.explode_messages(P.summary_prompts(document_summaries(spark, sf)), "name")


@register
def q_keyword_prompts(spark, sf):
    return P.explode_messages(P.keyword_prompts(B.requests(spark, sf)), "request_id")


@register
def q_assemble_stream(spark, sf):
    chunks = B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("reply_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    return P.assemble_stream(chunks)


@register
def q_chat_pairs(spark, sf):
    return P.chat_pairs(B.table(spark, sf, "conversations"))
