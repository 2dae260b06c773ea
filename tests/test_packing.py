"""Packing by pointer doubling against the fold and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators.packing import batch_starts, pack_large
from docweave.operators.tokens import pack_batches


def loop(tokens, limit):
    run, batch, out = 0, 0, []
    for t in tokens:
        out.append(batch)
        run += t
        if run > limit:
            run, batch = 0, batch + 1
    return out


def documents(seed):
    rnd = random.Random(seed)
    docs = {}
    for i in range(8):
        high = rnd.choice([1, 5, 40, 400])
        docs[f"d{i}"] = [rnd.choice([0, 0, rnd.randrange(high + 1), rnd.randrange(1, 900)])
                         if rnd.random() < 0.2 else rnd.randrange(high + 1) for _ in range(rnd.randrange(1, 300))]
    docs["zeros"] = [0] * 50
    docs["huge"] = [5000, 0, 0, 1, 5000, 3]
    return docs


@pytest.mark.parametrize("limit", [0, 30, 300])
def test_against_a_loop(spark, limit):
    docs = documents(limit)
    df = spark.createDataFrame([(n, p, "t", t) for n, ts in docs.items() for p, t in enumerate(ts)],
                               "name string, pos long, text string, n_tokens long").repartition(6)
    want = {(n, p): b for n, ts in docs.items() for p, b in enumerate(loop(ts, limit))}
    packed = pack_large(df, limit)
    assert packed.columns == ["name", "pos", "text", "n_tokens", "batch"]
    assert {(r.name, r.pos): r.batch for r in packed.collect()} == want
    both = pack_batches(df, limit + 10, reserve=10, fold_rows=100)
    assert {(r.name, r.pos): r.batch for r in both.collect()} == want


def test_negative_limits_are_refused(spark):
    with pytest.raises(ValueError):
        pack_large(spark.createDataFrame([("a", 0, 1)], "name string, pos long, n_tokens long"), -1)


def test_a_document_of_a_million_fragments(spark):
    df = spark.range(0, 1_000_000, 1, 16).select(
        F.lit("hot").alias("name"), F.col("id").alias("pos"), F.pmod(F.xxhash64("id"), F.lit(90)).alias("n_tokens"))
    packed = pack_large(df, 7167)
    tasks = packed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 1_000_000 and max(r["count"] for r in tasks) < 400_000
    tokens = [r.n_tokens for r in df.orderBy("pos").toLocalIterator()]
    ends = {}
    for p, b in enumerate(loop(tokens, 7167)):
        ends[b] = p
    got = {r.batch: r.last for r in packed.groupBy("batch").agg(F.max("pos").alias("last")).collect()}
    assert got == ends


def test_starts_are_found_in_logarithmic_rounds(spark, monkeypatch):
    from docweave.operators import packing
    written = []
    monkeypatch.setattr(packing, "materialize", lambda df, label: written.append(label) or df.checkpoint())
    values = spark.range(0, 3000, 1, 4).select(F.lit("d").alias("name"), (F.col("id") * 10).alias("v"))
    assert batch_starts(values, 29).count() == 1000
    assert written.count("pack-starts") <= 13
