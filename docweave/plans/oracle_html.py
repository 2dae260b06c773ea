"""DuckDB formulation of the main text of a page.

Relational where the library folds arrays: tokens are rows, the stack of open
elements is a recursive walk over the tags of each page, spans are pairs of
numbered rows, and link lists are found with ``lag`` and ``lead``.  Only the
table of character references is shared with the library.
"""

from __future__ import annotations

from docweave.plans.oracle_parts import q, strip
from docweave.sources.html import ENTITIES

_RAW = "script|style|noscript|template|textarea|iframe|svg"
_SIDE = "nav|header|footer|aside|form|head"
_HOLD = "main|article|section|div|ul|ol|dl|table|figure|details|blockquote"
_BREAK = "p|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|main|blockquote|figure|br|hr"

_TOKENS = "|".join(["(?s:<!--.*?-->)", *[f"(?is:<{r}\\b[^>]*>.*?</{r}\\s*>)" for r in _RAW.split("|")],
                    """<[/!?A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>""", "<[/!?A-Za-z][^>]*>", "[^<]+", "<"])
_AD = r"""(?i)^<[a-z][a-z0-9]*\b.*\sclass\s*=\s*(?:["'](?:[^"'>]*\s)?)?ad\b"""
_REFERENCE = "&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));"

SIDE_TAG = f"regexp_matches(t, '(?i)^<({_SIDE})\\b') OR regexp_matches(t, {q(_AD)})"
ARTICLE_TAG = "regexp_matches(t, '(?i)^<article\\b')"


def tokens_cte(src: str, name: str) -> str:
    """CTE ``name``(name, i, t) from a query with columns (name, html)."""
    return (f"{name} AS MATERIALIZED (SELECT name, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS t "
            f"FROM (SELECT name, regexp_extract_all(html, {q(_TOKENS)}) AS l FROM ({src})))")


def spans_cte(tok: str, opens: str, name: str) -> str:
    """CTE ``name``(name, n, a, b): outermost elements whose start tag fits ``opens``, tokens a <= i < b."""
    return f"""{name}_tags AS MATERIALIZED (
  SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) AS k,
    lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS el, t LIKE '</%' AS shut, ({opens}) AS hit
  FROM {tok} WHERE regexp_matches(t, '(?i)^</?({_SIDE}|{_HOLD})\\b')),
{name}_walk AS (
  SELECT DISTINCT name, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS open_, CAST(0 AS BIGINT) AS held,
    CAST(0 AS BIGINT) AS was, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS spot FROM {name}_tags
  UNION ALL
  SELECT name, k, CASE WHEN NOT shut THEN list_append(open_, el) WHEN spot = 0 THEN open_ ELSE open_[1:spot - 1] END,
    CASE WHEN shut AND spot > 0 AND held > 0 AND spot <= held THEN 0
         WHEN NOT shut AND hit AND held = 0 THEN len(open_) + 1 ELSE held END,
    held, i, spot
  FROM (SELECT w.name, g.k, g.i, g.el, g.shut, g.hit, w.open_, w.held,
          coalesce(list_max(list_filter(range(1, len(w.open_) + 1), lambda x: w.open_[x] = g.el)), 0) AS spot
        FROM {name}_walk w JOIN {name}_tags g ON g.name = w.name AND g.k = w.k + 1)),
{name}_a AS (SELECT name, i AS a, row_number() OVER (PARTITION BY name ORDER BY i) AS n FROM {name}_walk
  WHERE was = 0 AND held > 0),
{name}_b AS (SELECT name, i + CAST(spot = was AS BIGINT) AS b, row_number() OVER (PARTITION BY name ORDER BY i) AS n
  FROM {name}_walk WHERE was > 0 AND held = 0),
{name} AS (SELECT name, n, a, b FROM {name}_a JOIN {name}_b USING (name, n))"""


def _decoded(expr: str) -> str:
    number = f"regexp_extract(r, {q(_REFERENCE)}, 1)"
    code = (f"CASE WHEN {number} <> '' THEN CAST({number} AS INT) "
            f"ELSE CAST('0x' || regexp_extract(r, {q(_REFERENCE)}, 2) AS INT) END")
    char = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE r END"
    out = (f"list_reduce(list_transform(list_distinct(regexp_extract_all({expr}, {q(_REFERENCE)})), "
           f"lambda r: [r, {char}]), lambda acc, p: [replace(acc[1], p[1], p[2]), ''], [{expr}, ''])[1]")
    for entity, char in ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return out


def text_cte(tok: str, spans: str, name: str) -> str:
    """CTE ``name``(name, text): the tokens outside ``spans`` as lines, without lists of links."""
    return f"""{name}_kept AS (
  SELECT name, i, t FROM {tok} o
  WHERE NOT EXISTS (SELECT 1 FROM {spans} s WHERE s.name = o.name AND o.i >= s.a AND o.i < s.b)),
{name}_join AS (
  SELECT name, string_agg(CASE WHEN t = '<' OR t NOT LIKE '<%' THEN replace(replace(t, chr(1), ''), chr(2), '')
      WHEN regexp_matches(t, '(?i)^<(!--|({_RAW})\\b)') THEN ' '
      WHEN regexp_matches(t, '(?i)^</?({_BREAK})\\b') THEN chr(10)
      WHEN regexp_matches(t, '(?i)^<a\\b') THEN chr(1) WHEN regexp_matches(t, '(?i)^</a\\b') THEN chr(2)
      ELSE '' END, '' ORDER BY i) AS text
  FROM {name}_kept GROUP BY name),
{name}_line AS (
  SELECT name, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (
    SELECT name, string_split(text, chr(10)) AS l FROM {name}_join)),
{name}_bare AS (
  SELECT name, n, {strip("replace(replace(line, chr(1), ''), chr(2), '')")} AS line,
    {strip("replace(replace(regexp_replace(line, '\\x01[^\\x02]*\\x02?', '', 'g'), chr(1), ''), chr(2), '')")} AS rest
  FROM {name}_line),
{name}_flag AS (SELECT name, n, line, 2 * length(rest) < length(line) AS links FROM {name}_bare WHERE line <> ''),
{name}_list AS (
  SELECT name, n, line, links AND (coalesce(lag(links) OVER w, false) OR coalesce(lead(links) OVER w, false)) AS listed
  FROM {name}_flag WINDOW w AS (PARTITION BY name ORDER BY n)),
{name}_text AS (SELECT name, string_agg(line, chr(10) ORDER BY n) AS text FROM {name}_list WHERE NOT listed
  GROUP BY name),
{name} AS (SELECT name, {_decoded('text')} AS text FROM {name}_text)"""


def page_ctes(src: str, name: str = "page_text") -> str:
    """CTE ``name``(name, text) of the pages of a query with columns (name, html)."""
    return ",\n".join([tokens_cte(src, "tok"), spans_cte("tok", SIDE_TAG, "side"), text_cte("tok", "side", name)])


def article_ctes(name: str = "article_text") -> str:
    """CTE ``name``(name, text) of the article elements; needs the ``tok`` of ``page_ctes``."""
    inner = """art_tok AS MATERIALIZED (
  SELECT o.name, o.i, o.t FROM tok o JOIN art s ON s.name = o.name
    AND o.i > s.a AND o.i < s.b AND NOT (o.i = s.b - 1 AND o.t LIKE '</%')
  UNION ALL SELECT name, b, '<br>' FROM art)"""
    return ",\n".join([spans_cte("tok", ARTICLE_TAG, "art"), inner, spans_cte("art_tok", SIDE_TAG, "art_side"),
                       text_cte("art_tok", "art_side", name)])
