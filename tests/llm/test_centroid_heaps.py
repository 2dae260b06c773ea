import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.llm.centroid_heaps import clustered, heap_clusters
from docweave.llm.queries import ORACLE, QUERIES

SMOKE = "/root/testdata/sf0.001"


def lloyd(rows, k, rounds, dim):
    """Plain rounds over (vec_id, components)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and abs(c) < float("inf") for c in v):
            kept.append((i, [int(1024 * c // 1) for c in v]))
    mark = {i: hashlib.sha256(f"3:{i}".encode()).hexdigest() for i, _ in kept}
    order = sorted(kept, key=lambda r: (r[0] is None, mark[r[0]], r[1]))
    centres = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), c in zip(kept, own) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, c in last:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(centres[c])) for i, d, c in last)


def found(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"],
                    tuple(r["centroid"])) for r in df.collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


def clumps(rnd, n, dim, centres):
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i, [x + rnd.gauss(0, 0.3) for x in c]))
    return out


def test_rounds_against_plain_lloyd(spark):
    rnd = random.Random(4)
    centres = [[rnd.uniform(-3, 3) for _ in range(4)] for _ in range(5)]
    rows = clumps(rnd, 300, 4, centres) + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]
    rows += [(7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    bad = [(2000, None), (2001, []), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, None, 1.0, 1.0]),
           (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0])]
    docs = frame(spark, rows + bad)
    for name in ("x", "was", "cluster", "key", "centroid", "distance"):
        docs = docs.withColumn(name, F.lit(name))
    for k, rounds in ((8, 10), (3, 4), (1, 2), (8, 0)):
        assert found(clustered(docs, k, rounds, dim=4)) == lloyd(rows + bad, k, rounds, 4), (k, rounds)


def test_only_expired_vectors_are_measured(spark):
    rnd = random.Random(5)
    centres = [[12.0 * (j == i) for j in range(6)] for i in range(6)]
    rows = clumps(rnd, 600, 6, centres)
    got = heap_clusters(frame(spark, rows), 6, 10, dim=6)
    assert got.measured[0] == 600
    assert sum(got.measured[1:]) < 3 * 600 < 10 * 600
    assert got.measured[-1] == 0
    assert found(clustered(frame(spark, rows), 6, 10, dim=6)) == lloyd(rows, 6, 10, 6)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(50 + i, [0.5, 0.0]) for i in range(11)]
    assert found(clustered(frame(spark, rows), 8, 10, dim=2)) == lloyd(rows, 8, 10, 2)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.25, -0.25]), (2, [4.0, 4.0])]
    assert found(clustered(frame(spark, rows), 8, 3, dim=2)) == lloyd(rows, 8, 3, 2)
    none = clustered(frame(spark, rows), 8, 3, dim=3)
    assert none.count() == 0 and "centroid" in none.columns


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        clustered(frame(spark, [(1, [1e30, 0.0])]), 2, 1, dim=2).count()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMOKE}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op13_centroid_heaps']})").fetchall()
    got = QUERIES["op13_centroid_heaps"](spark, SMOKE).collect()
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)
