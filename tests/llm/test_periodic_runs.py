import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docweave.llm.lyndon import lyndon_array, repetitions
from docweave.llm.periodic_runs import periodic_runs, runs_of
from docweave.llm.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        words = [j for j in range(i + 1, len(w) + 1)
                 if all(w[i:j] < w[i + k:j] for k in range(1, j - i))]
        out.append(max(words) - i)
    return out


def brute_runs(w, exponent, least):
    """Every stretch with a period, for each period, that is the smallest of the stretch."""
    found = set()
    n = len(w)
    for q in range(1, n // exponent + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            j = i
            while same[j]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                part = w[i:i + length]
                if all(part[r:] != part[:-r] for r in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample_words(rnd):
    k = rnd.randrange(1, 4)
    def some(n):
        return [rnd.randrange(k) for _ in range(n)]
    unit = some(rnd.randrange(1, 8))
    return [some(rnd.randrange(0, 40)), (some(5) + unit * 9)[:rnd.randrange(1, 50)] + some(6),
            unit * 5 + some(1) + unit * 4 + some(2)][rnd.randrange(3)]


def test_grouping_gives_the_lyndon_array():
    rnd = random.Random(1)
    for _ in range(400):
        w = sample_words(rnd)
        assert lyndon_array(w) == brute_lyndon(w)
        assert lyndon_array([-x for x in w]) == brute_lyndon([-x for x in w])
    assert lyndon_array(list(range(20_000))) == list(range(20_000, 0, -1))
    assert lyndon_array([0] * 20_000) == [1] * 20_000


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (2, 6), (3, 3), (3, 4), (4, 4), (5, 6)])
def test_repetitions_against_brute_force(exponent, least):
    rnd = random.Random(exponent * 10 + least)
    texts = [sample_words(rnd) for _ in range(400)]
    want = [brute_runs(w, exponent, least) for w in texts]
    assert [repetitions(np.array(w, np.int64), exponent, least) for w in texts] == want
    joined = np.array([x for w in texts for x in w], np.int64)
    assert runs_of(joined, np.cumsum([len(w) for w in texts]).tolist(), exponent, least) == want


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows if len(r[1] or "") < 9000] + [
        (30, "x " * 5), (31, "x " * 6), (32, "a b\tc " * 4), (33, "q a b c " * 3 + "q a"), (33, "y " * 7),
        (34, " ".join(["u v"] * 6 + ["w"] * 9)), (35, "é é é é é é é"), (36, "  " * 8)]
    docs = make_docs(rows)
    for name in ("runs", "collapsed", "n_words", "start"):
        docs = docs.withColumn(name, F.lit(name))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in periodic_runs(docs).collect())
    want = []
    for i, t in rows:
        w = words_of(t)
        runs = brute_runs(w, 4, 6)
        want.append((str(i), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want)
    assert any(r[2] for r in got)


def test_very_long_texts(make_docs):
    rnd = random.Random(7)
    far = [f"w{rnd.randrange(3)}" for _ in range(7000)]
    rows = [(1, "the " * 200_000), (2, "x" * 300_000), (3, " ".join(far * 5)), (4, "a b " * 100_000 + "c")]
    got = {r.doc_id: r for r in periodic_runs(make_docs(rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 200_000, 1)] and got[1].collapsed == "the"
    assert got[2].runs == [] and got[2].collapsed == "x" * 300_000
    assert (0, 35_000, 7000) in [tuple(x) for x in got[3].runs]
    assert got[4].collapsed == "a b c"


def test_empty_and_bad_exponent(make_docs):
    assert periodic_runs(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(make_docs([]), exponent=1)


def expected(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 4, 6)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_registered_query_against_brute_force(spark):
    """The whole table but for texts on which the quadratic brute force would take minutes."""
    docs = pq.read_table(f"{SMOKE}/documents.parquet").to_pydict()
    short = {i: t for i, t in zip(docs["doc_id"], docs["text"]) if len(words_of(t)) <= 3000}
    assert len(short) > 0.9 * len(docs["doc_id"])
    rows = QUERIES["op12_periodic_runs"](spark, SMOKE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs["doc_id"])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for r in rows:
        if r["doc_id"] in short:
            assert tuple(r[n] for n in names) == expected(r["doc_id"], short[r["doc_id"]])
    assert sum(r["n_runs"] > 0 for r in rows) > 5
