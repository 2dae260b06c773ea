"""The operators bound to the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.bpe_codec import encode_decode
from docweave.llm.centroid_heaps import clustered
from docweave.llm.chunk_dedup import repeated_spans
from docweave.llm.common import let, table, words_of
from docweave.llm.decontaminate import benchmark_leaks
from docweave.llm.exact_dedup import exact_duplicates
from docweave.llm.language_id import fit_languages, label_languages
from docweave.llm.line_dedup import PAGE_LINES, drop_boilerplate, host_of, page_lines
from docweave.llm.near_dups import near_duplicates
from docweave.llm.periodic_runs import periodic_runs
from docweave.llm.quality_classifier import fit_quality, score_quality
from docweave.llm.quality_rules import quality_rules
from docweave.llm.sharding import balanced, shard_rows
from docweave.llm.token_count import token_counts

BYTE_BPE = "byte_bpe_50k.json"


# Lines on more than a tenth of the pages of a host, or half of those of a small one, and on three at least.
SITE_RATIO, SITE_PAGES, SITE_HITS, SMALL_RATIO = 0.1, 20, 3, 0.5


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), balanced(16))


def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines that stand on a large share of their host's pages."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text"))
    return drop_boilerplate(pages, "host", "text", SITE_RATIO, SITE_PAGES, SITE_HITS, small_ratio=SMALL_RATIO)


def op4_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op5_chunk_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op6_script_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = label_languages(docs, fit_languages(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_chosen_path_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("text_key")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model)


def op11_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), counters=1024)


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; in a tenth of the texts, by the id's checksum, the words from one place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")),
                                     F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    chosen = F.col("text").rlike(r"[^\x20\x09-\x0D]") & (h % 10 == 0)
    return docs.select("doc_id", F.when(chosen, let(words_of(F.col("text")), planted)).otherwise(F.col("text"))
                       .alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words, as digests, and the longest one."""
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")), exponent=4, least=6)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest)
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_centroid_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, salt="3:")
    components = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(components.cast("binary"), 256).alias("centroid_sha256"))


QUERIES = {
    "op1_hash_tree_sharding": op1_hash_tree_sharding,
    "op2_site_line_dedup": op2_site_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_mcd_quality_rules": op4_mcd_quality_rules,
    "op5_chunk_substring_dedup": op5_chunk_substring_dedup,
    "op6_script_viterbi_language": op6_script_viterbi_language,
    "op7_chosen_path_near_dups": op7_chosen_path_near_dups,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_co_trained_quality": op10_co_trained_quality,
    "op11_heavy_hitter_dedup": op11_heavy_hitter_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_heaps": op13_centroid_heaps,
}



def _page_lines_sql(html: str) -> str:
    for pattern, replacement in PAGE_LINES:
        quoted = pattern.replace("'", "''")
        html = f"regexp_replace({html}, '{quoted}', '{replacement}', 'g')"
    return html


_BLANKS = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"

OP2_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)), '') AS host,
         {_page_lines_sql('html')} AS text
  FROM pages),
l AS (
  SELECT p.rid, p.host, u.i, string_split(p.text, chr(10))[u.i] AS raw
  FROM p, LATERAL (SELECT unnest(range(1, len(string_split(p.text, chr(10))) + 1)) AS i) u),
t AS (SELECT rid, host, i, raw, trim(raw, {_BLANKS}) AS line FROM l),
bad AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT rid) AS n FROM t WHERE line <> '' GROUP BY ALL)
  JOIN (SELECT host, count(*) AS n_pages FROM p WHERE host IS NOT NULL GROUP BY host) USING (host)
  WHERE n >= {SITE_HITS} AND n > CASE WHEN n_pages >= {SITE_PAGES} THEN {SITE_RATIO} ELSE {SMALL_RATIO} END * n_pages),
k AS (SELECT t.*, bad.line IS NULL AS keep FROM t LEFT JOIN bad ON t.host = bad.host AND t.line = bad.line),
a AS (
  SELECT rid, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (keep), '') AS text,
         count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (NOT keep) AS n_dropped
  FROM k GROUP BY rid)
SELECT p.page_id, p.host, a.text, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped
FROM p LEFT JOIN a USING (rid)
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def _clusters_sql(k: int, rounds: int, dim: int, salt: str) -> str:
    """Plain Lloyd rounds over one row for each vector and component."""
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS xs
  FROM embeddings
  WHERE len(embedding) = {dim}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dim}),
x AS MATERIALIZED (SELECT rid, vec_id, unnest(range(1, {dim} + 1)) AS pos, unnest(xs) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT cluster, unnest(range(1, {dim} + 1)) AS pos, unnest(xs) AS c FROM (
    SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id::VARCHAR) NULLS LAST, xs) - 1 AS cluster, xs FROM v)
  WHERE cluster < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT rid, cluster, sum((x - c) * (x - c)) AS d FROM x JOIN c{r} USING (pos) GROUP BY rid, cluster)
  GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY cluster, pos),
c{r + 1} AS MATERIALIZED (
  SELECT cluster, pos, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c
  FROM c{r} LEFT JOIN m{r} USING (cluster, pos))""")
    return f"""
WITH {','.join(parts)},
h AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance,
       (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       centroid_sha256
FROM a{rounds} JOIN h USING (cluster) JOIN v USING (rid)
"""


ORACLE: dict[str, str] = {"op2_site_line_dedup": OP2_SQL, "op11_heavy_hitter_dedup": OP11_SQL,
                          "op13_centroid_heaps": _clusters_sql(8, 10, 64, "3:")}
