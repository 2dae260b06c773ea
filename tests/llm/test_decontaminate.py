import random

import pytest
from conftest import SMOKE

from docweave.llm import decontaminate, queries
from docweave.llm.decontaminate import ItemIndex, benchmark_leaks, terms_of, without_leaks

WORDS = [f"t{k}" for k in range(60)]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_block_max_wand_against_all_scores(monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rnd = random.Random(block)
    items = [(k, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 14)))) for k in range(120)]
    index = ItemIndex(items)
    for _ in range(150):
        query = {index.term_ids[t] for t in map(str.encode, rnd.sample(WORDS, rnd.randint(1, 25))) if t in index.term_ids}
        threshold = rnd.choice([0.2, 0.5, 0.7, 1.0])
        scores = [0.0] * len(index.items)
        for t in query:
            for i, w in zip(index.postings[t].items, index.postings[t].weights):
                scores[i] += w
        want = {i for i, s in enumerate(scores) if s >= threshold - 1e-9}
        got = index.retrieve(query, threshold)
        assert {i for i, _ in got} == want and len(got) == len(want)
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got)


def test_passages_keep_every_passage_that_can_score(spark):
    import numpy as np
    rnd = random.Random(9)
    index = ItemIndex([(k, " ".join(rnd.choices(WORDS, k=8))) for k in range(30)])
    for _ in range(30):
        words = [w.encode() for w in rnd.choices(WORDS + ["zz"] * 100, k=400)]
        ids = np.array([index.term_ids.get(w, -1) for w in words])
        open_ = set(index.passages(ids, 0.6))
        step = index.window // 2
        for a in range(0, 400, step):
            query = {int(t) for t in ids[a:a + index.window] if t >= 0}
            if index.retrieve(query, 0.6):
                assert (a, min(400, a + index.window)) in open_


def test_every_contained_item_is_found(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op8_benchmark_leaks(spark, SMOKE).collect()}
    folded = {d.doc_id: terms_of(d.text.encode()) for d in docs}
    assert want <= got
    for d, i in got - want:  # the same words, other punctuation
        needle = next(terms_of(b.text.encode()) for b in items if b.item_id == i)
        assert any(folded[d][k:k + len(needle)] == needle for k in range(len(folded[d])))


def test_blocks_of_the_given_items_do_not_change_scores(spark):
    docs, items = (spark.read.parquet(f"{SMOKE}/{n}.parquet") for n in ("documents", "benchmark"))
    key = lambda df: sorted((r.doc_id, r.item_id, round(r.score, 12)) for r in df.collect())
    whole = key(benchmark_leaks(docs, items, threshold=0.5))
    assert whole and key(benchmark_leaks(docs, items, threshold=0.5, block_items=20)) == whole


def item(rnd):
    return " ".join(rnd.choices([f"q{k}" for k in range(500)], k=18)) + ". " + " ".join(
        rnd.choices([f"a{k}" for k in range(500)], k=8)) + "."


def test_edits_answers_and_odd_rows(spark, make_docs, odd_rows):
    rnd = random.Random(10)
    texts = [item(rnd) for _ in range(12)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (50, None), (51, ""), (52, "!")],
                                  "item_id long, text string")
    filler = " ".join(rnd.choices([f"f{k}" for k in range(900)], k=700))
    question, answer = texts[1].split(". ")
    rows = odd_rows + [
        (100, f"{filler} {texts[0].upper()} {filler}"), (101, filler + " " + question),
        (102, filler + " " + answer), (103, filler), (104, texts[2].replace(" ", "  ")), (104, texts[2]),
        (105, f"{texts[3]} {filler} {texts[4]}")]
    docs = make_docs(rows)
    leaks = benchmark_leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in leaks.collect()) == [
        (100, 0), (104, 2), (104, 2), (105, 3), (105, 4)]
    clean = {r.doc_id for r in without_leaks(docs, leaks).collect()}
    assert clean == {r[0] for r in rows} - {100, 104, 105}
    key = lambda df: sorted(((r.doc_id, r.item_id, round(r.score, 12), r.question_overlap, r.answer_overlap)
                             for r in df.collect()))
    low = key(benchmark_leaks(docs, items, threshold=0.3, least_overlap=0.0))
    assert len(low) > len(leaks.collect())
    for sizes in (dict(block_items=1), dict(block_items=20), dict(block_items=4, block_bytes=300)):
        assert key(benchmark_leaks(docs, items, threshold=0.3, least_overlap=0.0, **sizes)) == low
    in_blocks = benchmark_leaks(docs, items, block_items=4)
    assert sorted((r.doc_id, r.item_id) for r in in_blocks.collect()) == sorted(
        (r.doc_id, r.item_id) for r in leaks.collect())
    assert benchmark_leaks(make_docs([]), items).count() == benchmark_leaks(docs, items.limit(0)).count() == 0
