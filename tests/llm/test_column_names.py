"""Extra columns with the names that operators use inside come through unchanged."""

from pyspark.sql import functions as F

from docweave.llm.chunk_dedup import repeated_spans, without_repeats
from docweave.llm.decontaminate import benchmark_leaks, without_leaks
from docweave.llm.exact_dedup import without_copies
from docweave.llm.line_dedup import drop_boilerplate
from docweave.llm.near_dups import one_of_each

NAMES = ["row", "id", "key", "_id", "_key", "text_key", "_drop", "drop", "_host", "_clean", "clean", "_salt", "_cuts",
         "cuts", "cut", "_text_key", "item_id", "kept", "n", "_n", "_rank", "doc", "a.b", "frequent", "keep_id"]
PASSAGE = " ".join(f"passage{k}" for k in range(70))
ROWS = [(1, f"alpha {PASSAGE} beta\nfoot", "en", "s"), (2, f"gamma {PASSAGE} delta\nfoot", "en", "s"),
        (3, "one two three four five six\nfoot", "en", "s"), (3, "one two three four five six\nfoot", "en", "s"),
        (4, "one two three four five six\nfoot", "en", "s"), (None, "q w e", None, None), (5, None, "en", "s")]


def with_names(make_docs):
    docs = make_docs(ROWS)
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


def check(docs, out, changed=("text",)):
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        own = "none" if r["doc_id"] is None else str(r["doc_id"])
        for k, name in enumerate(NAMES):
            if name not in changed:
                assert r[name] == f"{k}-{own}", name


def test_every_operator_that_returns_rows(spark, make_docs):
    docs = with_names(make_docs)
    out = one_of_each(docs)
    check(docs, out)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3, 5]
    out = without_copies(docs)
    check(docs, out)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 5]
    items = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    out = without_leaks(docs, benchmark_leaks(docs, items, least_overlap=0.0))
    check(docs, out)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 3, 4, 5]
    out = drop_boilerplate(docs, "source", "text", 0.1, 3, 3)
    check(docs, out)
    assert {r["n_dropped"] for r in out.collect()} == {0, 1, 2} and not any(
        "foot" in (r["text"] or "") for r in out.collect())
    out = without_repeats(docs, repeated_spans(docs))
    check(docs, out)
    assert out.columns == docs.columns and len(out.collect()) == len(ROWS)


def test_pipeline_stages(spark, make_docs):
    import corpus_pipeline
    docs = with_names(make_docs).withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        check(docs, out)
