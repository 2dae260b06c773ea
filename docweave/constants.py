"""Fixed values that results depend on, kept together in one place."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Tokens held back from every model window and every embedding batch.
RESERVE_TOKENS = 1024

# SIF smoothing constant.
SIF_ALPHA = 0.001

# Default number of fragments returned by a retrieval, and of summary candidates.
RETRIEVAL_LIMIT = 100
SUMMARY_CANDIDATES = 100

# Vector length requested from the embedding service.
DEFAULT_DIMENSIONS = 1536

# Languages summarised with the plain mean instead of the SIF centroid.
PLAIN_MEAN_LANGUAGES = ["zh", "ja", "ko", "hi", "ar", "fa"]

# Line endings that close a sentence when re-flowing extracted PDF lines, in
# their original order (the list holds 30 entries, one of them twice).
SENTENCE_CLOSERS = [
    ".", "!", "?", "。", "！", "？", "…", ";", "；", ":", "：", "”", "’", "）", "】", "》", "」",
    "』", "〕", "〉", "》", "〗", "〞", "〟", "»", '"', "'", ")", "]", "}",
]

# File kinds accepted for upload, by suffix.
SUPPORTED_SUFFIXES = [".pdf", ".txt", ".docx"]

# Preview sizes: console prints 5 fragments, the web view shows 20.
CONSOLE_PREVIEW = 5
WEB_PREVIEW = 20

# Chat models: name, context window, input and output price per 1k tokens.
CHAT_MODELS = [
    ("gpt-4-turbo-preview", 128000, 0.01, 0.03),
    ("gpt-4-0125-preview", 128000, 0.01, 0.03),
    ("gpt-4-1106-preview", 128000, 0.01, 0.03),
    ("gpt-4-vision-preview", 128000, 0.01, 0.03),
    ("gpt-4-1106-vision-preview", 128000, 0.01, 0.03),
    ("gpt-4", 8192, 0.03, 0.06),
    ("gpt-4-0613", 8192, 0.03, 0.06),
    ("gpt-4-32k", 32768, 0.06, 0.12),
    ("gpt-4-32k-0613", 32768, 0.06, 0.12),
    ("gpt-3.5-turbo", 4096, 0.0005, 0.0015),
    ("gpt-3.5-turbo-0125", 16385, 0.0005, 0.0015),
    ("gpt-3.5-turbo-1106", 16385, 0.0005, 0.0015),
    ("gpt-3.5-turbo-0613", 4096, 0.0005, 0.0015),
    ("gpt-3.5-turbo-16k", 16385, 0.0005, 0.0015),
    ("gpt-3.5-turbo-16k-0613", 16385, 0.0005, 0.0015),
]

# Embedding models: name, price per 1k tokens, max tokens per call, dimensions.
EMBEDDING_MODELS = [
    ("text-embedding-3-small", 0.00002, 8191, 1536),
    ("text-embedding-3-large", 0.00013, 8191, 1536),
    ("text-embedding-ada-002", 0.0001, 8191, 1536),
]

DEFAULT_CHAT_MODEL = "gpt-3.5-turbo"
DEFAULT_EMBEDDING_MODEL = "text-embedding-ada-002"

# ---------------------------------------------------------------------------
# Our own choices (not taken from anywhere; change freely)
# ---------------------------------------------------------------------------

# Hashing-embedder width used by the table bindings (the built-in embedder).
HASH_DIM = 64

# Embedding window used by the registered packing queries: small enough that
# the test documents span several batches (limit 300 after the reserve).
PACK_MAX_TOKENS = 1324

# Decimals of a score that count in a ranking: finer than FLOAT vectors can tell
# apart, coarser than the noise of summing in another order.
RANK_DECIMALS = 12

# Rows above which a side is never broadcast (bytes, estimated from a row bound).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
