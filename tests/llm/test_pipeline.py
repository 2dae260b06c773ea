"""Stages of the pipeline, each on its own input, against plain Python."""

from conftest import SMOKE

import corpus_pipeline
from docweave.llm.common import staged, table
from test_line_dedup import brute as brute_lines
from test_near_dups import brute as brute_near


def test_stages(spark):
    docs = table(spark, SMOKE, "documents")
    columns, last = docs.columns, None
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SMOKE), "test-" + name)
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        if name != "bpe_encoding":
            assert out.columns == columns
        if name == "quality_classifier":
            labels = {r.doc_id: r for r in table(spark, SMOKE, "labels").collect()}
            good = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            assert set(after) < set(before) and len(set(good) & set(after)) >= 0.95 * len(good)
        elif name == "line_dedup":
            rows = list(before.values())
            want = brute_lines([(r.source, r.text) for r in rows], 0.1, 20, 5)
            assert {r.doc_id: w[1] for r, w in zip(rows, want)} == {i: r.text for i, r in after.items()}
        elif name == "minhash_near_dedup":
            roots, _ = brute_near([(r.doc_id, r.text) for r in before.values()])
            assert set(after) == {i for i, root in roots.items() if i == root}
        elif name == "benchmark_decontamination":
            items = [r.text for r in table(spark, SMOKE, "benchmark").collect()]
            leaking = {i for i, r in before.items() if any(t in r.text for t in items)}
            assert leaking and not leaking & set(after)
            assert len(after) >= len(before) - len(leaking) - 2
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        docs, last = out, after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMOKE).collect()} == set(last)


def test_empty_table(spark):
    docs = table(spark, SMOKE, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMOKE), "test-empty")
        assert docs.count() == 0
