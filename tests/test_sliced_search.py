"""Top-k in large documents by slices, against the plain join."""

import random

import pytest

from docweave.operators import retrieval
from docweave.operators.retrieval import top_k_cosine, top_k_inner_product
from docweave.operators.sliced_search import large_documents, sliced_top_k

DIM = 6
SCHEMA = "name string, pos long, text string, embedding array<float>"


def made(spark, unit):
    rnd = random.Random(9)
    rows = []
    for name, n in (("hot", 900), ("warm", 130), ("cold", 20)):
        centre = [rnd.gauss(0, 1) for _ in range(DIM)]
        for i in range(n):
            v = [c + rnd.gauss(0, 1.5) for c in centre]
            if unit:
                length = sum(x * x for x in v) ** 0.5
                v = [x / length for x in v]
            else:
                v = [x * (1 + i % 7) for x in v]
            if i % 97 == 5:
                v = [0.0] * DIM
            if i % 89 == 7:
                v = [0.5] * DIM  # ties
            rows.append((name, i, f"{name}-{i}", v))
    questions = [(k, rnd.choice(["hot", "hot", "warm", "cold", "none"]), [rnd.gauss(0, 1) for _ in range(DIM)])
                 for k in range(30)]
    questions += [(100, "hot", [0.0] * DIM), (101, "hot", [0.5] * DIM), (102, "warm", [-1.0] * DIM)]
    return (spark.createDataFrame(questions, "request_id long, name string, embedding array<float>"),
            spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(retrieval, "fits", lambda *_: False)


def key(df, value):
    return sorted((r.request_id, r.rank, r.pos, r.text, None if r[value] is None else round(r[value], 9))
                  for r in df.collect())


@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("limit", [1, 200, 5000])
def test_equal_to_the_join(spark, no_broadcast, unit, limit):
    queries, index = made(spark, unit)
    for search, value in ((top_k_inner_product, "score"), (top_k_cosine, "distance")):
        want = key(search(queries, index, limit, None, DIM, carry=("text",)), value)
        got = key(search(queries, index, limit, 33, DIM, carry=("text",), slice_rows=40), value)
        assert got == want, (search.__name__, limit)


def test_slices_are_skipped_and_a_hot_document_is_spread(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(3000):  # a thousand like the question, the rest turned away from it
        x = 1.0 if i % 3 == 0 else -0.2
        rows.append(("hot", i, "", [x + rnd.gauss(0, 0.02), 1.0 - x + rnd.gauss(0, 0.02), 0.3, 0.1]))
    index = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(k, "hot", [1.0, 0.01 * k, 0.3, 0.1]) for k in range(20)],
                                    "request_id long, name string, embedding array<float>")
    large = large_documents(index, 100)
    for by_cosine in (False, True):
        hits, looked, total = sliced_top_k(queries, index, large, 10, 4, by_cosine, 100)
        assert total >= 20 * 30
        assert sum(looked) < total / 2
        assert hits.count() == 200 and all(r.pos % 3 == 0 for r in hits.collect())


def test_no_large_document(spark, no_broadcast):
    queries, index = made(spark, True)
    assert large_documents(index, 900).count() == 0
    assert key(top_k_cosine(queries, index, 5, 33, DIM, carry=("text",), slice_rows=900), "distance") == key(
        top_k_cosine(queries, index, 5, None, DIM, carry=("text",)), "distance")
