import random

import pytest
from conftest import SMOKE

from docweave.llm import near_dups, queries
from docweave.llm.near_dups import components, near_duplicates, one_of_each


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """id -> smallest reachable id, by comparing all pairs that share a shingle."""
    parent, holders, sets = {i: i for i, *_ in rows}, {}, [(i, shingles(t)) for i, t, *_ in rows]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for m in {m for z in s for m in holders.setdefault(z, [])}:
            j, o = sets[m]
            common = len(s & o)
            if 100 * common >= 75 * (len(s) + len(o) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for z in s:
            holders[z].append(n)
    return {i: root(i) for i, *_ in rows}, [(i, len(s)) for i, s in sets]


def check(docs, rows, **settings):
    roots, sizes = brute(rows)
    found = near_duplicates(docs, **settings).collect()
    assert sorted((r.doc_id, r.n_shingles) for r in found) == sorted(sizes)
    assert {r.doc_id: r.component_id for r in found} == roots
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    roots, _ = brute(rows)
    assert {r.doc_id: r.component_id for r in queries.op7_chosen_path_near_dups(spark, SMOKE).collect()} == roots


def family(rnd, n, edits, start):
    words = [f"w{rnd.randrange(9999)}" for _ in range(120)]
    out = []
    for k in range(n):
        copy = list(words)
        for _ in range(edits):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(9999)}"
        out.append((start + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("small_node, cluster_block", [(4000, 1_000_000), (6, 7_000)])
def test_families_and_large_nodes(make_docs, small_node, cluster_block):
    """With nodes of at most 6 classes the deepest nodes stay large: the blocks have to find all links."""
    rnd = random.Random(6)
    rows = family(rnd, 40, 1, 100) + family(rnd, 30, 3, 200) + family(rnd, 5, 2, 300) + family(rnd, 3, 8, 400)
    rnd.shuffle(rows)
    check(make_docs(rows), rows, small_node=small_node, cluster_block=cluster_block)


def test_odd_rows(make_docs, odd_rows):
    named = [r for r in odd_rows if r[0] is not None]
    found = near_duplicates(make_docs(odd_rows)).collect()
    roots, _ = brute(named)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == roots
    nameless = sorted(((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None), key=repr)
    assert nameless == sorted([(8, 5, False), (0, None, True)], key=repr)
    assert near_duplicates(make_docs([])).count() == 0
    kept = one_of_each(make_docs(odd_rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        [str(i) for i, root in roots.items() if i == root] + ["None", "None"])


def test_components_against_union_find(spark):
    rnd = random.Random(7)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.rec: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}


def test_estimate_margin():
    assert 0 < near_dups.least_matches(0.75) < near_dups.POSITIONS * 0.8125
