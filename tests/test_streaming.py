"""Streaming ingest indexes each content once, across drops and restarts."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from docweave.operators.identity import content_id_of_text
from docweave.sources.index import clear_names, read_index
from docweave.streaming.ingest import dedupe_stream, ingest_stream

HASH_DIM = 16


def drop(texts, folder, prefix):
    os.makedirs(folder, exist_ok=True)
    for i, t in enumerate(texts):
        with open(os.path.join(folder, f"{prefix}-{i}.txt"), "w", encoding="utf-8") as fh:
            fh.write(t)


def distinct_contents(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return (df.select(content_id_of_text(F.col("text")).alias("c"))
            .filter(F.size(F.split(F.col("c"), "")) > 0).distinct().count())


def run(spark, src, index, ckpt):
    q = ingest_stream(spark, src, index, ckpt, HASH_DIM)
    q.awaitTermination(300)
    return spark.read.parquet(index)


def test_ingest_exactly_once(spark, tmp_path):
    docs = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()]
    first, second = docs[:120], docs[80:200]
    src, index, ckpt = str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "ckpt")
    drop(first, src, "a")
    idx = run(spark, src, index, ckpt)
    n1 = idx.select("name").distinct().count()
    assert n1 == distinct_contents(spark, first)
    drop(second, src, "b")
    idx = run(spark, src, index, ckpt)
    n2 = idx.select("name").distinct().count()
    assert n2 == distinct_contents(spark, first + second)
    rows_before = idx.count()
    idx = run(spark, src, index, ckpt)            # restart, nothing new
    assert idx.count() == rows_before
    # every stored name holds one copy of its fragments
    dup = idx.groupBy("name", "pos").count().filter("count > 1").count()
    assert dup == 0


def names_of(idx):
    return {r.name for r in idx.select("name").distinct().collect()}


def test_two_sources_two_checkpoints_and_a_replay(spark, tmp_path):
    docs = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()]
    index = str(tmp_path / "index")
    drop(docs[:50], str(tmp_path / "a"), "a")
    first = names_of(run(spark, str(tmp_path / "a"), index, str(tmp_path / "ck-a")))
    drop(docs[49:100], str(tmp_path / "b"), "b")
    both = run(spark, str(tmp_path / "b"), index, str(tmp_path / "ck-b"))
    assert first <= names_of(both) and len(names_of(both)) == distinct_contents(spark, docs[:100])
    rows = both.count()
    # the same files under a new checkpoint: every batch is a replay
    again = run(spark, str(tmp_path / "a"), index, str(tmp_path / "ck-a2"))
    assert again.count() == rows
    assert again.groupBy("name", "pos").count().filter("count > 1").count() == 0


def test_cleared_document_can_come_back(spark, tmp_path):
    index = str(tmp_path / "index")
    drop(["one\ntwo", "three", "four\nfive"], str(tmp_path / "in"), "x")
    idx = run(spark, str(tmp_path / "in"), index, str(tmp_path / "c1"))
    before = sorted((r.name, r.pos, r.text) for r in idx.collect())
    gone = idx.filter("text = 'two'").select("name")
    clear_names(spark, index, spark.createDataFrame(gone.collect(), "name string"))
    assert read_index(spark, index).count() == 3
    idx = run(spark, str(tmp_path / "in"), index, str(tmp_path / "c2"))
    assert sorted((r.name, r.pos, r.text) for r in idx.collect()) == before


def test_a_damaged_index_is_not_taken_for_an_empty_one(spark, tmp_path):
    index = str(tmp_path / "index")
    drop(["one"], str(tmp_path / "in"), "x")
    run(spark, str(tmp_path / "in"), index, str(tmp_path / "c1"))
    for folder, _, files in os.walk(index):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(folder, f), "wb") as fh:
                    fh.write(b"damaged")
    with pytest.raises(Exception):
        run(spark, str(tmp_path / "in"), index, str(tmp_path / "c2"))


def test_dedupe_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(["same\ntext", "other", "same\ntext"], src, "x")
    stream = (spark.readStream.format("text").option("wholetext", True).schema("value string").load(src)
              .select(content_id_of_text(F.col("value")).alias("content_id")))
    q = (dedupe_stream(stream).writeStream.format("memory").queryName("dedupe_out")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) AS n FROM dedupe_out").collect()[0].n == 2


def test_folders_fed_at_the_same_time_give_each_document_once(spark, tmp_path):
    """Two live queries and one over both folders, all into one index at once."""
    docs = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()]
    index = str(tmp_path / "index")
    drop(docs[:60], str(tmp_path / "a"), "a")
    drop(docs[30:90], str(tmp_path / "b"), "b")
    queries = [ingest_stream(spark, src, index, str(tmp_path / f"ck-{k}"), HASH_DIM, shards=8, files_per_batch=25)
               for k, src in enumerate([str(tmp_path / "a"), str(tmp_path / "b"),
                                        [str(tmp_path / "a"), str(tmp_path / "b")]])]
    for q in queries:
        q.awaitTermination(300)
        assert q.exception() is None
    stored = spark.read.parquet(index)
    assert len(names_of(stored)) == distinct_contents(spark, docs[:90])
    assert stored.groupBy("name", "pos").count().filter("count > 1").count() == 0
    assert not os.path.exists(index + "_lock")


def test_a_lock_left_by_a_crash(spark, tmp_path):
    from docweave.streaming.ingest import index_lock, release_lock
    index = str(tmp_path / "index")
    with open(index + "_lock", "w") as fh:
        fh.write("me")
    with index_lock(spark, index, "me", 1):
        with pytest.raises(TimeoutError, match="locked by me"):
            with index_lock(spark, index, "you", 0.5):
                pass
    with open(index + "_lock", "w") as fh:
        fh.write("me")
    release_lock(spark, index)
    with index_lock(spark, index, "you", 1):
        pass


def test_a_backlog_uses_more_tasks_than_shards_and_stores_uri_and_tokens(spark, tmp_path):
    from docweave.functions.text import token_count
    from docweave.operators.embedding import python_hashing_embedder
    from docweave.operators.language import language_profiles
    from docweave.streaming.ingest import ingest_batch, ingest_report, documents_from_files
    drop([f"line {i} of this text\n{'word ' * 300}\nend {i}" for i in range(2000)], str(tmp_path / "in"), "x")
    index = str(tmp_path / "index")
    files = documents_from_files(spark.read.format("text").option("wholetext", True).load(str(tmp_path / "in")))
    profiles = language_profiles(spark.read.parquet(f"{SMOKE}/documents.parquet"))
    ingest_batch(files, index, HASH_DIM, shards=4, profiles=profiles, task_bytes=20_000, max_tokens=1324)
    written = [f for _, _, fs in os.walk(index) for f in fs if f.endswith(".parquet")]
    assert len({f.split("-")[1] for f in written}) > 40  # writing tasks, for 4 shards
    stored = spark.read.parquet(index)
    assert stored.select("name").distinct().count() == 2000 and stored.count() == 6000
    assert stored.filter(F.col("n_tokens") != token_count(F.col("text"))).count() == 0
    assert stored.filter(~F.col("uri").rlike("^[0-9a-f]{32}/(en|fr|de|es)$") | F.col("source").isNull()).count() == 0
    report = ingest_report(read_index(spark, index))
    assert report.agg(F.sum("fragments")).first()[0] == 6000 and report.filter("cost <= 0").count() == 0
    other = str(tmp_path / "other")
    ingest_batch(files, other, HASH_DIM, shards=4, max_tokens=1324, embedder=python_hashing_embedder(HASH_DIM))
    key = lambda p: sorted((r.name, r.pos, r.batch, r.n_tokens, [round(x, 6) for x in r.embedding])
                           for r in read_index(spark, p).collect())
    assert key(other) == key(index)
