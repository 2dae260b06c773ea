import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.llm.exact_dedup import decrement, exact_duplicates, frequent_digests, without_copies
from docweave.llm.queries import ORACLE, QUERIES

SMOKE = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    out = []
    for sha, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids)]
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_summary_keeps_every_frequent_digest():
    rnd = random.Random(2)
    for _ in range(200):
        counters = rnd.randrange(1, 6)
        rows = [rnd.choice("aaaabbbccdefghij").encode() for _ in range(rnd.randrange(1, 80))]
        counts = {}
        for i in range(0, len(rows), 7):
            for d, n in Counter(rows[i:i + 7]).items():
                counts[d] = counts.get(d, 0) + n
            counts = decrement(counts, counters)
        assert len(counts) <= counters
        for d, n in Counter(rows).items():
            assert n - len(rows) / (counters + 1) <= counts.get(d, 0) <= n


def test_merged_summaries(spark):
    rnd = random.Random(3)
    rows = [f"{rnd.choice('aaaabbb')}" if rnd.random() < 0.5 else f"r{i}" for i in range(3000)]
    df = spark.createDataFrame([(r,) for r in rows], "t string").repartition(23).select(
        F.col("t").cast("binary").alias("digest"))
    for counters, fan_in in ((4, 3), (10, 2), (7, 64)):
        got = {bytes(r["digest"]): r["n"] for r in frequent_digests(df, counters, fan_in).collect()}
        assert len(got) <= counters
        for d, n in Counter(rows).items():
            if n > len(rows) / (counters + 1):
                assert got[d.encode()] <= n


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_rows_against_brute_force(make_docs, odd_rows, counters):
    rows = [r[:2] for r in odd_rows] + [(20 + i, "hot \t text\n") for i in range(40)] + [
        (70, " hot text "), (71, "hot text"), (71, "hot text"), (72, "hot text "), (73, "hot text")]
    assert found(exact_duplicates(make_docs(rows).repartition(7), counters)) == brute(rows)


@pytest.mark.parametrize("counters", [1, 1024])
def test_without_copies_keeps_one_row_and_all_columns(spark, make_docs, odd_rows, counters):
    rows = [r[:2] for r in odd_rows] + [(20 + i // 2, "hot text") for i in range(40)] + [(5, "another text of five")]
    docs = make_docs(rows)
    for name in ("row", "at", "keep_id", "frequent", "group_size", "unknown", "text_sha256", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.withColumn("digest", F.lit("d"))
    left = without_copies(docs, counters)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["keep_id"], r["a.b"], r["digest"]) for r in left.collect())
    first = {}
    for i, t in rows:
        best = first.get(digest(t))
        if best is None or (i is not None and (best[0] is None or i < best[0])):
            first[digest(t)] = (i, t)
    want = Counter((i, None if t is None else t, "keep_id", "a.b", "d") for i, t in first.values())
    assert Counter((i, t or "", *x) for i, t, *x in got.elements()) == Counter(
        (i, t or "", *x) for i, t, *x in want.elements())


def test_empty(make_docs):
    assert exact_duplicates(make_docs([])).count() == 0
    assert without_copies(make_docs([])).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMOKE}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_heavy_hitter_dedup']})").fetchall()
    assert found(QUERIES["op11_heavy_hitter_dedup"](spark, SMOKE)) == Counter(want)


def test_frequent_copies_are_removed_without_a_shuffle(spark, make_docs):
    plan = exact_duplicates(make_docs([(i, "same") for i in range(9)]), 2)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert "strategy=broadcast" in text and "LeftAnti" in text
