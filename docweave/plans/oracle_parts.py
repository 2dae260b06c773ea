"""SQL fragments shared by the DuckDB oracle queries.

Where the Spark side works on arrays row by row, the SQL side mostly unnests
and aggregates relationally (sparse vectors, joins).  Both share the regular
expressions of ``functions.text`` and the fixed values, so agreement checks
the relational part and not those.
"""

from __future__ import annotations

from docweave.constants import HASH_DIM, PLAIN_MEAN_LANGUAGES, SENTENCE_CLOSERS
from docweave.functions.text import LINE_BREAK, TERM, TOKEN, WHITESPACE_CHARS, WHITESPACE_RUN

WS = "(" + "||".join(f"chr({ord(c)})" for c in WHITESPACE_CHARS) + ")"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def clean_lines(expr: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({expr}, {q(LINE_BREAK)}), "
            f"lambda x: {strip('x')}), lambda x: x <> '')")


def tokens(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q(TOKEN)})) AS BIGINT)"


def terms(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TERM)})"


def words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {q(WHITESPACE_RUN)}), lambda x: x <> '')"


def bucket(expr: str, dim: int = HASH_DIM) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT % {dim})"


def closers() -> str:
    return "[" + ", ".join(q(c) for c in SENTENCE_CLOSERS) + "]"


def mean_langs() -> str:
    return "(" + ", ".join(q(c) for c in PLAIN_MEAN_LANGUAGES) + ")"


def fragments_cte(docs_sql: str, name: str = "frag") -> str:
    """CTE ``name``(name, pos, text) from a query with columns (name, text)."""
    return (f"{name} AS (SELECT name, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, "
            f"unnest(l) AS text FROM (SELECT name, {clean_lines('text')} AS l FROM ({docs_sql})))")


def sparse_vectors_cte(src: str, keys: str, text: str, name: str, dim: int = HASH_DIM) -> str:
    """CTE ``name``(keys..., b, v): non-zero coordinates of the unit hashed term-count vector."""
    return f"""{name}_c AS (
  SELECT {keys}, b, count(*) AS c FROM (
    SELECT {keys}, unnest(list_transform({terms(text)}, lambda t: {bucket('t', dim)})) AS b FROM {src})
  GROUP BY ALL),
{name}_n AS (SELECT {keys}, sqrt(sum(c * c)) AS nrm FROM {name}_c GROUP BY ALL),
{name} AS (SELECT {keys}, b, CAST(c / nrm AS FLOAT) AS v FROM {name}_c JOIN {name}_n USING ({keys}))"""


REQUESTS_CTE = f"""req AS (
  SELECT concat_ws('-', conv_id, turn) AS request_id, conv_id AS name, {strip('text')} AS query
  FROM conversations WHERE role = 'user' AND {strip('text')} <> '')"""

DOCS = "SELECT doc_id AS name, text FROM documents"
