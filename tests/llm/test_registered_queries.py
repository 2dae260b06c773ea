"""Registered queries run whole on the smallest tables against plain Python versions of their results."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tokenizers
import xxhash
from conftest import SMOKE

from docweave.llm import queries
from docweave.llm.decontaminate import B, K1, overlap, question_and_answer, terms_of
from docweave.llm.quality_rules import BINS, DIMENSIONS, FLOORS, SHARE, STEPS, chi_square_cdf, chi_square_quantile
from docweave.llm.sharding import balanced, grown


def table(spark, name):
    return spark.read.parquet(f"{SMOKE}/{name}.parquet").collect()


def shard_of(key, tree):
    """Weighted hash draws down the tree, one node after another."""
    among = list(tree)
    for level in ("region", "rack", "shard"):
        weights = defaultdict(float)
        for leaf in among:
            weights[getattr(leaf, level)] += leaf.weight
        draws = []
        for node, weight in weights.items():
            seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
            bits = xxhash.xxh64_intdigest(f"{level}/{node}".encode(), seed=seed) >> 11
            draws.append((-math.log((bits + 0.5) / 2 ** 53) / weight, node))
        chosen = min(draws)[1]
        among = [leaf for leaf in among if getattr(leaf, level) == chosen]
    return among[0].shard


def test_op1_against_draws_one_by_one(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents")}
    rows = queries.op1_hash_tree_sharding(spark, SMOKE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == shard_of(r.doc_id, balanced(16))
        assert r.grown_shard == shard_of(r.doc_id, grown(balanced(16)))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op3_against_the_library(spark):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    docs = {r.doc_id: r.text or "" for r in table(spark, "documents")}
    rows = queries.op3_token_counts(spark, SMOKE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n = len(tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def binned_quantile(values, share):
    """The smallest value up to which at least ``share`` of all lie."""
    ordered = np.sort(values)
    return ordered[max(0, math.ceil(len(ordered) * share - 1e-9) - 1)]


def scatter(x):
    return x.mean(axis=0), x.T @ x / len(x) - np.outer(x.mean(axis=0), x.mean(axis=0)) + np.diag(np.square(FLOORS))


def distances(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def determinant_estimate(x):
    """Centre and scaled scatter of a group: two starts, concentration steps, the smaller determinant."""
    def median(v):
        return (np.array([binned_quantile(np.floor(c * BINS * 4), 0.5) for c in v.T]) + 0.5) / (4 * BINS)

    middle = median(x)
    spread = 1.4826 * median(np.abs(x - middle))
    fits = []
    for centre, cov in ((middle, np.diag(spread ** 2 + np.square(FLOORS))), scatter(x)):
        for _ in range(STEPS):
            bins = np.floor(np.log(distances(x, centre, cov) + 1e-9) * BINS)
            centre, cov = scatter(x[bins <= binned_quantile(bins, SHARE)])
        fits.append((round(np.linalg.slogdet(cov)[1], 12), centre, cov))
    _, centre, cov = min(fits, key=lambda f: f[0])
    return centre, cov * SHARE / chi_square_cdf(chi_square_quantile(SHARE, DIMENSIONS), DIMENSIONS + 2)


def test_op4_against_plain_estimates(spark):
    """Distances and verdicts recomputed group by group from the query's own base statistics, which test_quality_rules checks."""
    about = {r.doc_id: (r.lang, r.source) for r in table(spark, "documents")}
    rows = queries.op4_mcd_quality_rules(spark, SMOKE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(about)
    vectors = {}
    for r in rows:
        words, chars = max(r.n_words, 1), max(r.word_chars, 1)
        vectors[r.doc_id] = np.array([math.log(chars / words), math.sqrt(r.n_symbols / chars),
                                      math.sqrt(r.n_dup_lines / words), math.sqrt(r.n_repeat_words / words)])
    usable = [r.doc_id for r in rows if not r.base_failed]
    own = Counter(about[i] for i in usable)
    group = {i: (about[i] if own[about[i]] >= 50 else about[i][0]) if about[i] in own else None for i in about}
    members = defaultdict(list)
    for i in usable:
        members[group[i]].append(i)
    estimates = {g: determinant_estimate(np.array([vectors[i] for i in ids])) for g, ids in members.items() if len(ids) >= 50}
    assert estimates
    limit = chi_square_quantile(0.99, DIMENSIONS)
    for r in rows:
        if group[r.doc_id] in estimates:
            d2 = float(distances(vectors[r.doc_id][None], *estimates[group[r.doc_id]])[0])
            assert abs(r.distance2 - d2) <= 1e-6 * max(1.0, d2), r
            assert r.kept == (not r.base_failed and r.distance2 <= limit)
        else:
            assert r.distance2 is None and r.kept == (not r.base_failed)


def test_op8_against_every_item_in_every_window(spark):
    """Scores of all items in all windows by plain sums; the best confirmed one of each document and item."""
    docs, items = table(spark, "documents"), []
    for r in sorted({(r.item_id, r.text) for r in table(spark, "benchmark") if r.text}):
        terms = terms_of(r[1].encode())
        if terms:
            items.append((r[0], Counter(terms), len(terms), *question_and_answer(r[1])))
    df = Counter(t for _, c, *_ in items for t in c)
    mean = sum(n for _, _, n, *_ in items) / len(items)
    weights = []
    for _, c, n, *_ in items:
        raw = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1)
               / (f + K1 * (1 - B + B * n / mean)) for t, f in c.items()}
        weights.append({t: w / sum(raw.values()) for t, w in raw.items()})
    size = max(64, 2 * max(n for _, _, n, *_ in items))
    want = {}
    for d in docs:
        words = terms_of((d.text or "").encode())
        for a in range(0, max(1, len(words)), size // 2):
            passage = words[a:a + size]
            there = set(passage)
            for (item_id, _, _, question, answer), w in zip(items, weights):
                score = sum(x for t, x in w.items() if t in there)
                if score >= 0.7 - 1e-9:
                    shares = overlap(question, passage, 5), overlap(answer, passage, 5)
                    if min(shares) >= 0.6:
                        key = d.doc_id, item_id
                        want[key] = max(want.get(key, (0.0,)), (score, *shares))
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap)
           for r in queries.op8_benchmark_leaks(spark, SMOKE).collect()}
    assert got.keys() == want.keys() and want
    for key, values in want.items():
        assert np.allclose(got[key], (min(1.0, values[0]), *values[1:]), atol=1e-9)
