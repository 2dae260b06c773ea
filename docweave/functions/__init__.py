"""Column-level building blocks: text patterns, vector arithmetic, hashing."""

from docweave.functions.hashing import hashed_vector, term_bucket  # noqa: F401
from docweave.functions.text import (  # noqa: F401
    clean_lines, strip_ws, terms, token_count, words,
)
from docweave.functions.vectors import cosine, dot, norm, normalize, scale, vmax  # noqa: F401
