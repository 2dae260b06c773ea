"""SIF, centroids, scores and summaries on document rows against the operators on fragment tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.functions.hashing import bucket_runs, hashed_vector, sparse_dot, sparse_unit
from docweave.functions.text import terms
from docweave.functions.vectors import dot
from docweave.operators import summary as S
from docweave.operators.document_rows import (
    central, document_centroids, document_rows, fragment_scores, sif_centroids, sif_weights, summary_rows,
)
from docweave.operators.embedding import hashing_embedder, python_hashing_embedder
from docweave.operators.fragments import split_fragments
from docweave.plans.sizing import materialize
from docweave.plans.summarize import summary_context

DIM = 16


def made_docs(spark):
    rnd = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "delta.", "eps", "zeta", "eta,", "théta", "x", "..."]
    rows = []
    for i in range(12):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 9))) for _ in range(1 + 3 * i)]
        rows.append((i, "\n".join(lines), "zh" if i % 4 == 0 else "en"))
    rows += [(50, None, "en"), (51, "", "en"), (52, "... !!\n??", "en"), (53, "!!\nalpha", "zh"), (54, "one", None)]
    return spark.createDataFrame(rows, "name long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return made_docs(spark)


@pytest.fixture(scope="module")
def table(spark, docs):
    frags = hashing_embedder(split_fragments(docs, keep=("lang",)), DIM, keep_terms=True)
    return materialize(frags, "test-fragments")


@pytest.fixture(scope="module", params=[1000, 4, 1], ids=["one row", "slices of 4", "slices of 1"])
def rows(request, docs):
    return request.param, materialize(document_rows(docs, DIM, slice_rows=request.param), "test-rows")


def by_position(df, size, column):
    out = {}
    for r in df.select("name", "slice", column).collect():
        for k, v in enumerate(r[column]):
            out[r["name"], r["slice"] * size + k] = None if v is None else round(v, 9)
    return out


def vectors(df):
    return {r["name"]: None if r["centroid"] is None else [round(x, 9) for x in r["centroid"]]
            for r in df.select("name", "centroid").distinct().collect()}


def table_weights(table):
    return S.sif_weight(table, S.idf(S.document_frequency(table), table))


def test_slices_hold_every_fragment_once(rows, table):
    size, stored = rows
    got = {(r.name, r.slice * size + k): (t, [round(x, 6) for x in v]) for r in stored.collect()
           for k, (t, v) in enumerate(zip(r.texts, r.embeddings))}
    assert got == {(r.name, r.pos): (r.text, [round(x, 6) for x in r.embedding]) for r in table.collect()}
    assert all(len(r.texts) <= size for r in stored.collect())


def test_weights_and_centroids(rows, table):
    size, stored = rows
    want = {(r.name, r.pos): round(r.weight, 9) for r in table_weights(table).collect()}
    weighted = sif_weights(stored)
    assert by_position(weighted, size, "weights") == want
    found = vectors(sif_centroids(weighted))
    assert found == vectors(S.sif_mean_vector(table_weights(table)))


def test_scores_and_candidates(rows, docs, table):
    from docweave.plans.summarize import centroids
    size, stored = rows
    routed = document_centroids(sif_weights(stored.withColumn("method", S.summary_method(F.col("lang")))))
    methods = docs.select("name", S.summary_method(F.col("lang")).alias("method"))
    scored = S.centrality(table, centroids(table, methods))
    got = by_position(routed.withColumn("s", fragment_scores(F.col("centroid"), F.col("embeddings"))), size, "s")
    assert got == {(r.name, r.pos): None if r.score is None else round(r.score, 9) for r in scored.collect()}
    best = {r.name: [(b.pos, b.text) for b in r.best] for r in central(routed, 3).collect()}
    want = {}
    for r in S.central_fragments(scored, 3).orderBy("name", "rank").collect():
        want.setdefault(r.name, []).append((r.pos, r.text))
    assert best == want


@pytest.mark.parametrize("budget", [0, 25, 10_000])
def test_summaries(rows, docs, table, budget):
    _, stored = rows
    key = lambda df: sorted((r.name, r.method, r.n_fragments, r.context) for r in df.collect())
    assert key(summary_rows(stored, budget, 5)) == key(summary_context(table, docs, 5, budget))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bExchange\b", line)], plan


def test_whole_documents_move_nothing(docs):
    stored = materialize(document_rows(docs, DIM), "test-rows")
    lines, _ = exchanges(summary_rows(stored, 100))
    assert lines == []


def test_vectors_of_sliced_documents_stay_where_they_are(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = materialize(document_rows(docs, DIM, slice_rows=3), "test-rows")
        plan = summary_rows(stored, 100)._jdf.queryExecution().executedPlan()
        moved = [plan.toString().count("Exchange hashpartitioning")]
        walk, names = [plan], []
        while walk:
            node = walk.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                node = node.initialPlan()
            if node.nodeName() == "Exchange":
                names += [a.name() for a in (node.output().apply(i) for i in range(node.output().size()))]
            walk += [node.children().apply(i) for i in range(node.children().size())]
        assert moved[0] > 0 and names
        assert "embeddings" not in names and "texts" not in names
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("dim", [3, 64, 1536])
def test_hashed_vectors_of_any_width(spark, dim):
    rnd = random.Random(dim)
    texts = ["", "...", "one", "a1 a1 a1 b2", *[" ".join(f"t{rnd.randrange(60)}" for _ in range(80)) for _ in range(20)]]
    df = spark.createDataFrame([(t, texts[-1 - i]) for i, t in enumerate(texts)], "a string, b string")
    want = python_hashing_embedder(dim)(texts)
    got = df.select(hashed_vector(terms(F.col("a")), dim).alias("v")).collect()
    assert [[round(x, 6) for x in r.v] for r in got] == [[round(x, 6) for x in v] for v in want]
    pairs = df.select(
        dot(hashed_vector(terms(F.col("a")), dim), hashed_vector(terms(F.col("b")), dim)).alias("d"),
        sparse_dot(sparse_unit(terms(F.col("a")), dim), sparse_unit(terms(F.col("b")), dim)).alias("s"),
        bucket_runs(terms(F.col("a")), dim).alias("r")).collect()
    for r in pairs:
        assert abs(r.d - r.s) < 1e-9
        assert r.r["index"] == sorted(set(r.r["index"])) and len(r.r["index"]) == len(r.r["value"])


@pytest.mark.parametrize("size", [1000, 4])
def test_weights_made_with_the_rows(spark, docs, table, size):
    """One pass makes vectors and weights; slices of a document get theirs from all of it."""
    from docweave.constants import SIF_ALPHA

    twice = docs.unionByName(docs.filter("name = 3"))
    stored = materialize(document_rows(twice, DIM, slice_rows=size, alpha=SIF_ALPHA), "test-rows")
    whole = stored.filter(F.size("texts") == F.col("n_fragments"))
    assert whole.filter("terms IS NOT NULL").count() == 0 and whole.filter("size(weights) != size(texts)").count() == 0
    if size == 1000:
        want = {(r.name, r.pos): round(r.weight, 9) for r in table_weights(table).collect()}
        assert by_position(sif_weights(stored), size, "weights") == want
        single = vectors(sif_centroids(sif_weights(stored)))
        assert single == vectors(S.sif_mean_vector(table_weights(table)))
        plan = sif_weights(stored)._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "Exchange" not in plan
    else:
        plain = materialize(document_rows(docs, DIM, slice_rows=size), "test-rows")
        mine = materialize(document_rows(docs, DIM, slice_rows=size, alpha=SIF_ALPHA), "test-rows")
        assert by_position(sif_weights(mine), size, "weights") == by_position(sif_weights(plain), size, "weights")


def test_whole_documents_are_summed_and_ranked_by_numpy(spark, docs):
    """Vectors are not folded component by component, and short labels are not cut into tokens."""
    from docweave.constants import SIF_ALPHA
    from docweave.operators.document_rows import central_by_method

    odd = spark.createDataFrame([(60, "a 𝒳 𝒳𝒳 _ _x 7 77\nÀB àb\x85same line\nsame line\n İi ß", "en"),
                                 (60, "same\nsame\n...", "zh"), (None, "a b c\nab ab", "en")], docs.schema)
    every = docs.unionByName(odd).unionByName(docs.filter("name = 3"))
    stored = materialize(document_rows(every, DIM, alpha=SIF_ALPHA), "test-rows")
    plain = materialize(document_rows(every, DIM), "test-rows")
    both = [sorted((str(r.name), r.slice, r.embeddings) for r in df.collect()) for df in (stored, plain)]
    assert both[0] == both[1]
    routed = sif_weights(stored.withColumn("method", S.summary_method(F.col("lang"))))
    for k in (1, 2, 100):
        got, want = (sorted((str(r.name), [tuple(b) for b in r.best]) for r in df.collect())
                     for df in (central_by_method(routed, k), central(document_centroids(routed), k)))
        assert got == want
    plan = summary_rows(stored, 100)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "zip_with" not in plan
