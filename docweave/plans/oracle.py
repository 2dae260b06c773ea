"""DuckDB twins of the registered queries (same column names, same rounding)."""

from __future__ import annotations

from docweave.constants import DEFAULT_DIMENSIONS, HASH_DIM, RANK_DECIMALS, RETRIEVAL_LIMIT
from docweave.plans.answer import context_budget
from docweave.plans.oracle_parts import (
    DOCS, NL, REQUESTS_CTE, clean_lines, fragments_cte, sparse_vectors_cte, terms, tokens,
)

ORACLE: dict[str, str] = {}

ORACLE["split_fragments"] = f"WITH {fragments_cte(DOCS)} SELECT name, pos, text FROM frag"

ORACLE["content_id"] = (
    f"SELECT doc_id, md5(array_to_string({clean_lines('text')}, {NL})) AS content_id FROM documents")

ORACLE["token_count"] = f"WITH {fragments_cte(DOCS)} SELECT name, pos, {tokens('text')} AS n_tokens FROM frag"

ORACLE["hashing_embedder"] = f"""WITH {fragments_cte(DOCS)},
{sparse_vectors_cte('frag', 'name, pos', 'text', 'fv')}
SELECT name, pos, b, round(CAST(v AS DOUBLE), 6) AS v FROM fv"""

ORACLE["hashing_embedder_wide"] = f"""WITH {fragments_cte(DOCS)},
{sparse_vectors_cte('frag', 'name, pos', 'text', 'fv', DEFAULT_DIMENSIONS)}
SELECT name, pos, b, round(CAST(v AS DOUBLE), 6) AS v FROM fv"""

# Keywords: all question terms in the target document's vocabulary by tf * idf; a question with
# none keeps its own terms by tf.  Every question has a row.
KEYWORDS_CTES = f"""{REQUESTS_CTE},
{fragments_cte('SELECT doc_id AS name, text FROM documents WHERE doc_id IN (SELECT name FROM req)')},
dfreq AS (SELECT name, term, count(*) AS df FROM (
  SELECT DISTINCT name, pos, term FROM (SELECT name, pos, unnest({terms('text')}) AS term FROM frag))
  GROUP BY ALL),
nfrag AS (SELECT name, count(*) AS n FROM frag GROUP BY ALL),
idf AS (SELECT name, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfreq JOIN nfrag USING (name)),
qterm AS (SELECT request_id, name, term, count(*) AS tf FROM (
  SELECT request_id, name, unnest({terms('query')}) AS term FROM req) GROUP BY ALL),
hit AS (SELECT request_id, name, term, tf * idf AS w FROM qterm JOIN idf USING (name, term)),
own AS (SELECT request_id, name, term, tf AS w FROM qterm WHERE request_id NOT IN (SELECT request_id FROM hit)),
kwrank AS (SELECT request_id, name, term, row_number() OVER (
  PARTITION BY request_id ORDER BY round(w, {RANK_DECIMALS}) DESC, term ASC) AS rn
  FROM (SELECT * FROM hit UNION ALL SELECT * FROM own)),
kwlist AS (SELECT request_id, string_agg(term, ',' ORDER BY rn) AS keywords FROM kwrank GROUP BY ALL),
kw AS (SELECT request_id, name, coalesce(keywords, '') AS keywords,
  request_id IN (SELECT request_id FROM hit) AS matched FROM req LEFT JOIN kwlist USING (request_id))"""

# Exact top-k over sparse vectors: every fragment of the document is scored
# (0 when no bucket is shared), ranked by score then position.
ANSWER_HITS_CTES = f"""{KEYWORDS_CTES},
{sparse_vectors_cte('kw', 'request_id', 'keywords', 'qv')},
{sparse_vectors_cte('frag', 'name, pos', 'text', 'fv')},
dots AS (SELECT kw.request_id, fv.pos, sum(CAST(qv.v AS DOUBLE) * CAST(fv.v AS DOUBLE)) AS s
  FROM kw JOIN qv USING (request_id) JOIN fv ON fv.name = kw.name AND fv.b = qv.b GROUP BY ALL),
scored AS (SELECT kw.request_id, frag.name, frag.pos, frag.text, round(coalesce(dots.s, 0), {RANK_DECIMALS}) AS score
  FROM kw JOIN frag ON frag.name = kw.name
  LEFT JOIN dots ON dots.request_id = kw.request_id AND dots.pos = frag.pos),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos ASC) - 1
  AS BIGINT) AS rank FROM scored),
hits AS (SELECT *, 'paragraph ' || pos || ': ' || text AS label FROM ranked WHERE rank < {RETRIEVAL_LIMIT}),
hits_tok AS (SELECT *, {tokens('label')} AS n_tokens FROM hits)"""

ORACLE["answer_context"] = f"""WITH {ANSWER_HITS_CTES},
cut AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY request_id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM hits_tok),
ctx AS (SELECT request_id, string_agg(rank || '. ' || label, {NL} ORDER BY rank) AS context,
  count(*) AS n_fragments FROM cut WHERE earlier <= {context_budget()} GROUP BY request_id)
SELECT kw.request_id, kw.name, kw.keywords, CASE WHEN ctx.context IS NULL THEN 'unknown document'
  WHEN kw.matched THEN 'answered' ELSE 'no match' END AS status,
  coalesce(ctx.n_fragments, 0) AS n_fragments, ctx.context
FROM kw LEFT JOIN ctx USING (request_id)"""


# ---------------------------------------------------------------- more shared SQL

from docweave.constants import (  # noqa: E402
    CHAT_MODELS, CONSOLE_PREVIEW, DEFAULT_CHAT_MODEL, DEFAULT_EMBEDDING_MODEL, EMBEDDING_MODELS,
    PACK_MAX_TOKENS, RESERVE_TOKENS, SIF_ALPHA, SUMMARY_CANDIDATES,
)
from docweave.operators import prompts as P  # noqa: E402
from docweave.plans.oracle_html import article_ctes, page_ctes  # noqa: E402
from docweave.plans.oracle_parts import closers, mean_langs, q, strip, words  # noqa: E402
from docweave.sources.files import _SUFFIX  # noqa: E402

DOC_FRAG = fragments_cte(DOCS)

CONV_FRAG = f"""conv_frag AS (
  SELECT name, turn, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line, unnest(l) AS text
  FROM (SELECT conv_id AS name, turn, {clean_lines('text')} AS l FROM conversations))"""


def kind_sql(expr: str) -> str:
    path = f"lower(regexp_replace({expr}, '(?i)^(https?://[^?#]*)[?#].*$', '\\1'))"
    k = f"coalesce(regexp_extract({path}, {q(chr(92) + '.' + _SUFFIX + '$')}, 1), '')"
    return f"CASE WHEN {k} = '' THEN 'unsupported' ELSE {k} END"


def price(model: str, table, col: int) -> str:
    value = {m[0]: m for m in table}[model][col]
    return f"CAST({value!r} AS DOUBLE)"


ORACLE["source_kind"] = f"""
SELECT 'documents' AS origin, doc_id AS id, {kind_sql('source')} AS kind FROM documents
UNION ALL
SELECT 'pages' AS origin, page_id AS id, {kind_sql('url')} AS kind FROM pages"""

ORACLE["append_positions"] = f"""WITH {DOC_FRAG}, {CONV_FRAG},
start AS (SELECT name, max(pos) + 1 AS s FROM frag GROUP BY name)
SELECT c.name, c.turn, c.line,
  CAST(coalesce(s.s, 0) + row_number() OVER (PARTITION BY c.name ORDER BY c.turn, c.line) - 1 AS BIGINT) AS pos,
  c.text
FROM conv_frag c LEFT JOIN start s USING (name)"""

ORACLE["index_scan"] = f"""WITH {REQUESTS_CTE}, {DOC_FRAG}
SELECT name, pos, text FROM frag WHERE name IN (SELECT name FROM req)"""

ORACLE["index_clear"] = f"""WITH {DOC_FRAG}
SELECT name, pos, text FROM frag WHERE name NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""

ORACLE["index_reindex"] = f"""WITH {DOC_FRAG}, {CONV_FRAG}
SELECT name, pos, text FROM frag WHERE name NOT IN (SELECT name FROM conv_frag)
UNION ALL
SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY turn, line) - 1 AS BIGINT) AS pos, text
FROM conv_frag"""

ORACLE["reflow_lines"] = f"""WITH {CONV_FRAG},
flag AS (SELECT name, turn AS page, line AS pos, text, coalesce(sum(
    CASE WHEN list_contains({closers()}, right(text, 1)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY name, turn ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
  FROM conv_frag),
sent AS (SELECT name, page, sentence, string_agg(text, '' ORDER BY pos) AS text FROM flag GROUP BY ALL),
pp AS (SELECT name, page, count(*) AS n FROM sent GROUP BY ALL),
off AS (SELECT name, page, coalesce(sum(n) OVER (PARTITION BY name ORDER BY page
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM pp)
SELECT name, page, CAST(o + sentence AS BIGINT) AS pos, text FROM sent JOIN off USING (name, page)"""

PAGE_CTES = page_ctes("SELECT page_id AS name, html FROM pages")

ORACLE["html_fragments"] = f"""WITH RECURSIVE {PAGE_CTES},
{fragments_cte('SELECT name, text FROM page_text')}
SELECT name, pos, text FROM frag"""

ORACLE["html_fallback"] = f"""WITH RECURSIVE {PAGE_CTES},
{article_ctes()},
{fragments_cte(f"SELECT name, coalesce(nullif({strip('a.text')}, ''), p.text) AS text "
               "FROM page_text p FULL JOIN article_text a USING (name)")}
SELECT name, pos, text FROM frag"""

ORACLE["paragraph_fragments"] = f"""
SELECT conv_id AS name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos,
  {strip('text')} AS text
FROM conversations WHERE {strip('text')} <> ''"""

_CID = f"md5(array_to_string({clean_lines('text')}, {NL}))"
ORACLE["document_uri"] = f"""WITH u AS (SELECT doc_id, {_CID} || '/' || left(lang, 2) AS uri FROM documents)
SELECT doc_id, uri, split_part(uri, '/', 1) AS uri_id, split_part(uri, '/', 2) AS uri_lang FROM u"""

ORACLE["rejected_documents"] = f"""WITH RECURSIVE {PAGE_CTES},
{fragments_cte('SELECT name, text FROM page_text')}
SELECT 'documents' AS origin, doc_id AS id FROM documents
WHERE text IS NULL OR len({clean_lines('text')}) = 0
UNION ALL
SELECT 'pages' AS origin, page_id AS id FROM pages WHERE page_id NOT IN (SELECT name FROM frag)"""

ORACLE["label_paragraphs"] = f"""WITH {DOC_FRAG}
SELECT name, pos, 'paragraph ' || pos || ': ' || text AS label FROM frag"""

ORACLE["numbered_list"] = f"""WITH {DOC_FRAG}
SELECT name, string_agg(pos || '. paragraph ' || pos || ': ' || text, {NL} ORDER BY pos) AS numbered,
  count(*) AS n_items FROM frag GROUP BY name"""

ORACLE["context_preview"] = f"""WITH {ANSWER_HITS_CTES}
SELECT request_id, rank, label FROM hits WHERE rank < {CONSOLE_PREVIEW}"""

ORACLE["clean_queries"] = f"WITH {REQUESTS_CTE} SELECT request_id, name, query FROM req"


def trigram_sql(src: str, keys: str) -> str:
    """(keys..., gram) rows: every trigram of every space-padded lower-case letter run."""
    return f"""SELECT {keys}, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS gram
  FROM (SELECT {keys}, ' ' || unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) || ' ' AS p FROM {src})"""


PROFILE_CTES = f"""g AS (SELECT lang, gram, count(*) AS tf FROM ({trigram_sql('documents', 'lang')}) GROUP BY ALL),
vocab AS (SELECT count(DISTINCT gram) AS v FROM g),
ndocs AS (SELECT count(*) AS n FROM documents),
pl AS (SELECT lang, sum(tf) AS total FROM g GROUP BY lang),
dl AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
st AS (SELECT lang, total + (SELECT v FROM vocab) AS den, ln(docs / (SELECT n FROM ndocs)) AS prior
  FROM pl JOIN dl USING (lang)),
prof AS (SELECT lang, gram, ln((tf + 1.0) / den) AS logp, ln(1.0 / den) AS unseen, prior FROM g JOIN st USING (lang))"""

ORACLE["language_profiles"] = f"""WITH {PROFILE_CTES}
SELECT lang, gram, round(logp, 6) AS logp, round(unseen, 6) AS unseen, round(prior, 6) AS prior FROM prof"""

def detected_ctes(src: str, keys: list[str]) -> str:
    """CTE ``det``(keys..., lang): every text of ``src`` with its most probable language."""
    k, on = ", ".join(keys), " AND ".join(f"m.{x} = c.{x}" for x in keys)
    return f"""{PROFILE_CTES},
tg AS (SELECT {k}, gram, count(*) AS tf FROM ({trigram_sql(src, k)}) GROUP BY ALL),
tot AS (SELECT {k}, sum(tf) AS all_tf FROM tg GROUP BY ALL),
per_lang AS (SELECT lang, any_value(unseen) AS unseen, any_value(prior) AS prior FROM prof GROUP BY lang),
m AS (SELECT {k}, lang, sum(tf * (logp - unseen)) AS gain FROM tg JOIN prof USING (gram) GROUP BY ALL),
sc AS (SELECT {", ".join("c." + x for x in keys)}, l.lang,
    round(l.prior + coalesce(tot.all_tf, 0) * l.unseen + coalesce(m.gain, 0), 9) AS score
  FROM {src} c CROSS JOIN per_lang l LEFT JOIN tot USING ({k}) LEFT JOIN m ON {on} AND m.lang = l.lang),
det AS (SELECT {k}, left(lang, 2) AS lang FROM (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, lang) AS rn FROM sc) WHERE rn = 1)"""


ORACLE["detect_language"] = f"""WITH {detected_ctes('conversations', ['conv_id', 'turn'])}
SELECT conv_id, turn, lang FROM det"""

ORACLE["detected_documents"] = f"""WITH {detected_ctes('documents', ['doc_id'])}
SELECT doc_id, det.lang, CASE WHEN det.lang IN {mean_langs()} THEN 'mean' ELSE 'sif' END AS method,
  md5(array_to_string({clean_lines('text')}, {NL})) || '/' || det.lang AS uri
FROM documents JOIN det USING (doc_id)"""

ORACLE["summary_method"] = f"""
SELECT doc_id, lang, CASE WHEN lang IN {mean_langs()} THEN 'mean' ELSE 'sif' END AS method FROM documents"""

ORACLE["split_keywords"] = f"""WITH {KEYWORDS_CTES}
SELECT request_id, CAST(rn - 1 AS BIGINT) AS idx, term AS keyword FROM kwrank"""

# Greedy inclusive packing as a recursive walk over positions.
PACK_CTES = f"""{DOC_FRAG},
t AS (SELECT name, pos, {tokens('text')} AS n_tokens FROM frag),
r AS (
  SELECT name, pos, n_tokens, n_tokens AS run, CAST(0 AS BIGINT) AS batch FROM t WHERE pos = 0
  UNION ALL
  SELECT t.name, t.pos, t.n_tokens,
    CASE WHEN r.run > {PACK_MAX_TOKENS - RESERVE_TOKENS} THEN t.n_tokens ELSE r.run + t.n_tokens END,
    CASE WHEN r.run > {PACK_MAX_TOKENS - RESERVE_TOKENS} THEN r.batch + 1 ELSE r.batch END
  FROM r JOIN t ON t.name = r.name AND t.pos = r.pos + 1)"""

ORACLE["pack_batches"] = f"WITH RECURSIVE {PACK_CTES} SELECT name, pos, n_tokens, batch FROM r"

ORACLE["batch_totals"] = f"""WITH RECURSIVE {PACK_CTES}
SELECT name, batch, CAST(GROUPING(name, batch) AS BIGINT) AS level, CAST(sum(n_tokens) AS BIGINT) AS tokens,
  count(*) AS fragments FROM r GROUP BY ROLLUP (name, batch)"""

RANKED_CTE = f"""{DOC_FRAG},
t AS (SELECT name, pos, {tokens('text')} AS n_tokens FROM frag),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY name ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {context_budget()} AS kept FROM t)"""

ORACLE["cut_to_budget"] = f"WITH {RANKED_CTE} SELECT name, pos, n_tokens FROM c WHERE kept"

ORACLE["cut_report"] = f"""WITH {RANKED_CTE}
SELECT name, count(*) AS candidates, CAST(sum(CAST(kept AS INT)) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN kept THEN n_tokens ELSE 0 END) AS BIGINT) AS kept_tokens,
  CAST(max(CAST(NOT kept AS INT)) AS BOOLEAN) AS was_cut
FROM c GROUP BY name"""

_IN = price(DEFAULT_CHAT_MODEL, CHAT_MODELS, 2)
_OUT = price(DEFAULT_CHAT_MODEL, CHAT_MODELS, 3)
ORACLE["chat_cost"] = f"""WITH u AS (
  SELECT conv_id,
    CAST(sum(CASE WHEN role IN ('user', 'system') THEN {tokens('text')} ELSE 0 END) AS BIGINT) AS prompt_tokens,
    CAST(sum(CASE WHEN role = 'assistant' THEN {tokens('text')} ELSE 0 END) AS BIGINT) AS completion_tokens
  FROM conversations GROUP BY conv_id)
SELECT conv_id, {q(DEFAULT_CHAT_MODEL)} AS model, prompt_tokens, completion_tokens,
  prompt_tokens + completion_tokens AS total_tokens,
  round(prompt_tokens / CAST(1000 AS DOUBLE) * {_IN}, 10) AS input_cost,
  round(completion_tokens / CAST(1000 AS DOUBLE) * {_OUT}, 10) AS output_cost,
  round(prompt_tokens / CAST(1000 AS DOUBLE) * {_IN} + completion_tokens / CAST(1000 AS DOUBLE) * {_OUT}, 10)
    AS total_cost, true AS known_model
FROM u"""

ORACLE["embedding_cost"] = f"""WITH RECURSIVE {PACK_CTES}
SELECT name, batch, {q(DEFAULT_EMBEDDING_MODEL)} AS model, CAST(sum(n_tokens) AS BIGINT) AS tokens,
  round(sum(n_tokens) / CAST(1000 AS DOUBLE) * {price(DEFAULT_EMBEDDING_MODEL, EMBEDDING_MODELS, 1)}, 10) AS cost
FROM r GROUP BY name, batch"""

ORACLE["embedding_cost_totals"] = f"""WITH RECURSIVE {PACK_CTES},
c AS (SELECT name, batch, sum(n_tokens) AS tokens,
  round(sum(n_tokens) / CAST(1000 AS DOUBLE) * {price(DEFAULT_EMBEDDING_MODEL, EMBEDDING_MODELS, 1)}, 10) AS cost
  FROM r GROUP BY name, batch)
SELECT name, CAST(GROUPING(name) AS BIGINT) AS level, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS batches,
  round(sum(cost), 9) AS cost FROM c GROUP BY ROLLUP (name)"""

ORACLE["embed_fragments"] = ORACLE["hashing_embedder"]

ORACLE["check_dimension"] = f"""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, coalesce(len(embedding) = {HASH_DIM}, false) AS valid
FROM embeddings"""

QUESTION_HITS_CTES = f"""{REQUESTS_CTE},
{fragments_cte('SELECT doc_id AS name, text FROM documents WHERE doc_id IN (SELECT name FROM req)')},
{sparse_vectors_cte('req', 'request_id', 'query', 'qv')},
{sparse_vectors_cte('frag', 'name, pos', 'text', 'fv')},
dots AS (SELECT req.request_id, fv.pos, sum(CAST(qv.v AS DOUBLE) * CAST(fv.v AS DOUBLE)) AS s
  FROM req JOIN qv USING (request_id) JOIN fv ON fv.name = req.name AND fv.b = qv.b GROUP BY ALL),
scored AS (SELECT req.request_id, frag.name, frag.pos, round(coalesce(dots.s, 0), {RANK_DECIMALS}) AS score
  FROM req JOIN frag ON frag.name = req.name
  LEFT JOIN dots ON dots.request_id = req.request_id AND dots.pos = frag.pos),
qhits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos ASC) - 1
  AS BIGINT) AS rank FROM scored) WHERE rank < {RETRIEVAL_LIMIT})"""

ORACLE["top_k_inner_product"] = f"WITH {QUESTION_HITS_CTES} SELECT request_id, rank, pos, round(score, 6) AS score FROM qhits"

ORACLE["fetch_fragments"] = f"""WITH {QUESTION_HITS_CTES}
SELECT h.request_id, h.rank, h.pos, f.text FROM qhits h JOIN frag f USING (name, pos)"""

VEC_CTES = """e AS (SELECT CAST(label AS BIGINT) AS name, vec_id AS pos, embedding FROM embeddings),
u AS (SELECT name, pos, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
cen AS (SELECT name, i, avg(x) AS c FROM u GROUP BY ALL)"""

ORACLE["mean_vector"] = f"WITH {VEC_CTES} SELECT name, i, round(c, 6) AS value FROM cen WHERE c <> 0"

ORACLE["top_k_cosine"] = f"""WITH {VEC_CTES},
cn AS (SELECT name, sqrt(sum(c * c)) AS cn FROM cen GROUP BY ALL),
en AS (SELECT name, pos, sqrt(sum(x * x)) AS en FROM u GROUP BY ALL),
d AS (SELECT u.name, u.pos, sum(u.x * cen.c) AS dot FROM u JOIN cen USING (name, i) GROUP BY ALL),
s AS (SELECT d.name, d.pos, round(1 - CASE WHEN en * cn = 0 THEN NULL ELSE dot / (en * cn) END, {RANK_DECIMALS}) AS distance
  FROM d JOIN en USING (name, pos) JOIN cn USING (name))
SELECT name AS request_id, rank, pos, round(distance, 6) AS distance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY distance ASC NULLS LAST, pos) - 1 AS BIGINT) AS rank
  FROM s) WHERE rank < {RETRIEVAL_LIMIT}"""

_LABELLED_IDS = f"""ids AS (SELECT doc_id, {_CID} AS content_id FROM documents),
idx AS (SELECT DISTINCT content_id FROM ids WHERE doc_id IN (SELECT doc_id FROM labels))"""

ORACLE["already_indexed"] = f"""WITH {_LABELLED_IDS}
SELECT doc_id, content_id FROM ids WHERE content_id IN (SELECT content_id FROM idx)"""

ORACLE["new_documents"] = f"""WITH {_LABELLED_IDS}
SELECT content_id, min(doc_id) AS doc_id FROM ids WHERE content_id NOT IN (SELECT content_id FROM idx)
GROUP BY content_id"""

ORACLE["unknown_documents"] = f"""WITH {REQUESTS_CTE}, {DOC_FRAG}
SELECT request_id, name FROM req
WHERE name NOT IN (SELECT name FROM frag WHERE name IN (SELECT doc_id FROM labels))"""

ORACLE["extract_keywords"] = f"WITH {KEYWORDS_CTES} SELECT request_id, name, keywords, matched FROM kw"

DF_CTES = f"""{DOC_FRAG},
dfreq AS (SELECT name, term, count(*) AS df FROM (
  SELECT DISTINCT name, pos, term FROM (SELECT name, pos, unnest({terms('text')}) AS term FROM frag))
  GROUP BY ALL),
nfrag AS (SELECT name, count(*) AS n FROM frag GROUP BY ALL),
idf AS (SELECT name, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfreq JOIN nfrag USING (name))"""

ORACLE["document_frequency"] = f"WITH {DF_CTES} SELECT name, term, df FROM dfreq"
ORACLE["idf"] = f"WITH {DF_CTES} SELECT name, term, round(idf, 6) AS idf FROM idf"
ORACLE["vocabulary"] = f"WITH {DF_CTES} SELECT DISTINCT name, term FROM dfreq"

SIF_CTES = f"""{DF_CTES},
{sparse_vectors_cte('frag', 'name, pos', 'text', 'fv')},
occ AS (SELECT name, pos, unnest({words('text')}) AS term FROM frag),
wsum AS (SELECT name, pos, sum({SIF_ALPHA!r} / ({SIF_ALPHA!r} + idf)) AS weight FROM occ JOIN idf USING (name, term)
  GROUP BY ALL),
weights AS (SELECT frag.name, frag.pos, coalesce(wsum.weight, 0) AS weight FROM frag LEFT JOIN wsum USING (name, pos)),
method AS (SELECT doc_id AS name, CASE WHEN lang IN {mean_langs()} THEN 'mean' ELSE 'sif' END AS method FROM documents),
mx AS (SELECT name, pos, max(v) AS mx FROM fv GROUP BY ALL),
k AS (SELECT w.name, w.pos, (1 - w.weight) / mx.mx AS k FROM weights w JOIN mx USING (name, pos)),
nk AS (SELECT name, count(*) AS n FROM weights GROUP BY name),
sif_cen AS (SELECT fv.name, fv.b AS i, sum(k.k * CAST(fv.v AS DOUBLE)) / any_value(nk.n) AS c
  FROM fv JOIN k USING (name, pos) JOIN nk USING (name) GROUP BY fv.name, fv.b),
nall AS (SELECT name, count(*) AS n FROM frag GROUP BY name),
mean_cen AS (SELECT fv.name, fv.b AS i, sum(CAST(fv.v AS DOUBLE)) / any_value(nall.n) AS c
  FROM fv JOIN nall USING (name) GROUP BY fv.name, fv.b),
cen AS (SELECT s.* FROM sif_cen s JOIN method m USING (name) WHERE m.method = 'sif'
  UNION ALL SELECT p.* FROM mean_cen p JOIN method m USING (name) WHERE m.method = 'mean'),
has_cen AS (SELECT name FROM nall),
cn AS (SELECT name, sqrt(sum(c * c)) AS cn FROM cen GROUP BY ALL),
vn AS (SELECT name, pos, sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS vn FROM fv GROUP BY ALL),
dt AS (SELECT fv.name, fv.pos, sum(CAST(fv.v AS DOUBLE) * cen.c) AS d
  FROM fv JOIN cen ON cen.name = fv.name AND cen.i = fv.b GROUP BY ALL),
score AS (SELECT f.name, f.pos, f.text,
  round(CASE WHEN vn.vn IS NULL OR coalesce(cn.cn, 0) = 0 THEN NULL ELSE coalesce(dt.d, 0) / (vn.vn * cn.cn) END,
    {RANK_DECIMALS}) AS score
  FROM frag f JOIN has_cen USING (name) LEFT JOIN cn USING (name) LEFT JOIN vn USING (name, pos)
  LEFT JOIN dt USING (name, pos)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC NULLS LAST, pos ASC) - 1 AS BIGINT)
  AS rank FROM score)"""

ORACLE["sif_weight"] = f"WITH {SIF_CTES} SELECT name, pos, round(weight, 9) AS weight FROM weights"
ORACLE["sif_mean_vector"] = f"WITH {SIF_CTES} SELECT name, i, round(c, 6) AS value FROM sif_cen WHERE c <> 0"
ORACLE["centrality"] = f"WITH {SIF_CTES} SELECT name, pos, round(score, 6) AS score FROM score"
ORACLE["central_fragments"] = f"WITH {SIF_CTES} SELECT name, rank, pos, round(score, 6) AS score FROM ranked WHERE rank < 3"

# Summaries are routed by the language found in the text, not by the label.
_BY_LABEL = f"method AS (SELECT doc_id AS name, CASE WHEN lang IN {mean_langs()} THEN 'mean' ELSE 'sif' END AS method FROM documents)"
_BY_TEXT = (f"{detected_ctes('documents', ['doc_id'])},\n"
            f"method AS (SELECT doc_id AS name, CASE WHEN lang IN {mean_langs()} THEN 'mean' ELSE 'sif' END AS method FROM det)")

SUMMARY_CTES = f"""{SIF_CTES.replace(_BY_LABEL, _BY_TEXT)},
cand AS (SELECT *, 'paragraph ' || pos || ': ' || text AS label FROM ranked WHERE rank < {SUMMARY_CANDIDATES}),
cand_tok AS (SELECT *, {tokens('label')} AS n_tokens FROM cand),
cut AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY name ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM cand_tok),
sctx AS (SELECT name, string_agg(rank || '. ' || label, {NL} ORDER BY rank) AS context, count(*) AS n_fragments
  FROM cut WHERE earlier <= {context_budget()} GROUP BY name)"""

ORACLE["summary_context"] = f"""WITH {SUMMARY_CTES}
SELECT name, method, n_fragments, context FROM sctx JOIN method USING (name)"""

ORACLE["summary_prompts"] = f"""WITH {SUMMARY_CTES}
SELECT name, CAST(0 AS BIGINT) AS seq, 'system' AS role,
  {q(P.SUMMARY_HEAD)} || context || {q(P.SUMMARY_TAIL.format(language='English'))} AS content FROM sctx"""

ORACLE["answer_prompts"] = f"""WITH {ANSWER_HITS_CTES},
cut AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY request_id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM hits_tok),
ctx AS (SELECT request_id, string_agg(rank || '. ' || label, {NL} ORDER BY rank) AS context
  FROM cut WHERE earlier <= {context_budget()} GROUP BY request_id),
msg AS (SELECT request_id, CAST(0 AS BIGINT) AS seq, 'system' AS role,
    {q(P.ANSWER_HEAD)} || context || {q(P.ANSWER_TAIL.format(language='English'))} AS content FROM ctx
  UNION ALL
  SELECT request_id, CAST(1 AS BIGINT) AS seq, 'user' AS role, query AS content
  FROM req WHERE request_id IN (SELECT request_id FROM ctx))
SELECT request_id, seq, role, content FROM msg"""

ORACLE["keyword_prompts"] = f"""WITH {REQUESTS_CTE}
SELECT request_id, CAST(0 AS BIGINT) AS seq, 'user' AS role,
  {q(P.KEYWORD_HEAD)} || query || {q(P.KEYWORD_TAIL)} AS content FROM req"""

ORACLE["assemble_stream"] = f"""
SELECT conv_id AS reply_id, {strip("string_agg(text, '' ORDER BY turn)")} AS reply
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"""

ORACLE["chat_pairs"] = """
SELECT conv_id, turn, text AS question, next_text AS answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
WHERE role = 'user' AND next_role = 'assistant'"""

_URIS = f"""{detected_ctes('documents', ['doc_id'])},
uris AS (SELECT doc_id, {_CID} || '/' || det.lang AS uri FROM documents JOIN det USING (doc_id))"""

ORACLE["answer_by_uri"] = f"""WITH {_URIS}, answered AS ({ORACLE["answer_context"]})
SELECT a.request_id, u.uri, CASE WHEN u.uri IS NULL THEN NULL ELSE a.keywords END AS keywords,
  CASE WHEN u.uri IS NULL THEN 'not found' ELSE a.status END AS status, a.n_fragments, a.context
FROM answered a LEFT JOIN uris u ON u.doc_id = a.name"""

ORACLE["summary_by_uri"] = f"""WITH {_URIS}, summed AS ({ORACLE["summary_context"]})
SELECT u.doc_id AS request_id, u.uri, CASE WHEN s.context IS NULL THEN 'not found' ELSE 'summarised' END AS status,
  s.method, coalesce(s.n_fragments, 0) AS n_fragments, s.context
FROM uris u LEFT JOIN summed s ON s.name = u.doc_id"""
