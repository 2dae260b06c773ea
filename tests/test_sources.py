"""File sources, the sharded index lifecycle, and the caller-supplied function hooks."""

import os

import pytest
from pyspark.sql import functions as F

from docweave.operators.embedding import (
    embed_fragments, embed_query, hashing_embedder, python_hashing_embedder,
)
from docweave.operators.prompts import answer_prompts, complete
from docweave.sources.files import read_text_documents, select_supported
from docweave.sources.html import article_html
from docweave.sources.index import (
    clear_index, clear_names, commit_index, read_index, reindex, replace_documents, write_index,
)


def test_read_text_and_dispatch(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n", encoding="utf-8")
    (tmp_path / "b.TXT").write_text("x", encoding="utf-8")
    (tmp_path / "c.md").write_text("y", encoding="utf-8")
    docs = read_text_documents(spark, str(tmp_path))
    assert docs.count() == 3
    kinds = sorted((os.path.basename(r.uri), r.kind) for r in select_supported(docs).collect())
    assert kinds == [("a.txt", "txt"), ("b.TXT", "txt")]
    assert read_text_documents(spark, str(tmp_path), glob="*.txt").count() == 1


def index_rows(spark, names, per=3):
    data = [(n, p, f"{n}-{p}", [float(p)]) for n in names for p in range(per)]
    return spark.createDataFrame(data, "name string, pos long, text string, embedding array<float>")


def test_index_commit_clear_and_reindex(spark, tmp_path):
    path = str(tmp_path / "idx")
    write_index(index_rows(spark, ["a", "b", "c"]), path, shards=4)
    current = read_index(spark, path).drop("shard")
    gone = spark.createDataFrame([("b",), ("zz",)], "name string")
    commit_index(spark, clear_index(current, gone), path, gone)
    after = read_index(spark, path)
    assert sorted({r.name for r in after.collect()}) == ["a", "c"]
    assert after.count() == 6
    new = index_rows(spark, ["a"], per=1).withColumn("text", F.lit("new"))
    changed = reindex(read_index(spark, path).drop("shard"), new)
    commit_index(spark, changed, path, new)
    got = sorted((r.name, r.pos, r.text) for r in read_index(spark, path).collect())
    assert got == [("a", 0, "new"), ("c", 0, "c-0"), ("c", 1, "c-1"), ("c", 2, "c-2")]


def test_user_embedder_matches_builtin(spark):
    frags = spark.createDataFrame([("d", 0, "Alpha beta beta", 0), ("d", 1, "gamma, delta!", 0),
                                   ("e", 0, "x", 0)], "name string, pos long, text string, batch long")
    hook = {(r.name, r.pos): [round(x, 6) for x in r.embedding]
            for r in embed_fragments(frags, 16, embedder=python_hashing_embedder(16)).collect()}
    native = {(r.name, r.pos): [round(x, 6) for x in r.embedding]
              for r in hashing_embedder(frags, 16).collect()}
    assert hook == native


def test_complete_with_stub(spark):
    ctx = spark.createDataFrame([("r1", "0. paragraph 0: hi")], "request_id string, context string")
    req = spark.createDataFrame([("r1", "what?")], "request_id string, query string")
    prompts = answer_prompts(ctx, req)

    def stub(message_lists):
        return [(f"  {len(m)} messages  ", 10, 2) for m in message_lists]

    out = complete(prompts, "request_id", stub, "gpt-3.5-turbo").collect()[0]
    assert (out.reply, out.prompt_tokens, out.completion_tokens, out.model) == ("2 messages", 10, 2, "gpt-3.5-turbo")


def test_embed_query_hook_matches_builtin(spark):
    req = spark.createDataFrame([("r1", "d", "alpha,beta"), ("r2", "d", "gamma")],
                                "request_id string, name string, keywords string")
    hook = {r.request_id: [round(x, 6) for x in r.embedding]
            for r in embed_query(req, 8, embedder=python_hashing_embedder(8)).collect()}
    native = {r.request_id: [round(x, 6) for x in r.embedding] for r in embed_query(req, 8).collect()}
    assert hook == native


def test_commit_empties_a_shard(spark, tmp_path):
    path = str(tmp_path / "idx1")
    write_index(index_rows(spark, ["only"]), path, shards=4)
    gone = spark.createDataFrame([("only",)], "name string")
    current = read_index(spark, path).drop("shard")
    commit_index(spark, clear_index(current, gone), path, gone)
    assert read_index(spark, path).count() == 0


def test_second_write_continues_positions(spark, tmp_path):
    path = str(tmp_path / "idx2")
    write_index(index_rows(spark, ["a", "b"]), path, shards=4)
    write_index(index_rows(spark, ["a", "c"], per=2), path)
    got = sorted((r.name, r.pos) for r in read_index(spark, path).collect())
    assert got == [("a", p) for p in range(5)] + [("b", p) for p in range(3)] + [("c", p) for p in range(2)]


def test_shard_count_is_stored(spark, tmp_path):
    path = str(tmp_path / "idx3")
    names = [f"n{k}" for k in range(40)]
    write_index(index_rows(spark, names), path, shards=8)
    with pytest.raises(ValueError):
        write_index(index_rows(spark, ["x"]), path, shards=16)
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    assert read_index(spark, path, wanted).count() == 120
    assert read_index(spark, path, ["n7"]).count() == 3


def test_overwrite_replaces_everything(spark, tmp_path):
    path = str(tmp_path / "idx4")
    write_index(index_rows(spark, ["a", "b", "c"]), path, shards=8)
    write_index(index_rows(spark, ["d"]), path, shards=2, mode="overwrite")
    assert [r.name for r in read_index(spark, path).select("name").distinct().collect()] == ["d"]


def test_stored_clear_and_replace(spark, tmp_path):
    path = str(tmp_path / "idx5")
    write_index(index_rows(spark, ["a", "b"]), path, shards=4)
    clear_names(spark, path, spark.createDataFrame([("a",)], "name string"))
    replace_documents(spark, path, index_rows(spark, ["b"], per=1))
    write_index(index_rows(spark, ["a"], per=2), path)
    assert sorted((r.name, r.pos) for r in read_index(spark, path).collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_suffix_of_files_and_addresses(spark):
    kinds = {"C# notes.pdf": "pdf", "what? no.TXT": "txt", "https://x.org/a.pdf?x=1#p": "pdf",
             "https://x.org/a?f=b.pdf": "unsupported", "a.docx": "docx", "a.pdf.zip": "unsupported", None: "unsupported"}
    df = spark.createDataFrame([(k,) for k in kinds], "uri string")
    from docweave.sources.files import source_kind
    assert {r.uri: r.kind for r in df.select("uri", source_kind(F.col("uri")).alias("kind")).collect()} == kinds


def test_all_articles_are_read(spark):
    df = spark.createDataFrame([("<article>a</article><p>x</p><ARTICLE id=1>b</ARTICLE>",), ("<p>none</p>",)], "h string")
    assert [r.a for r in df.select(article_html(F.col("h")).alias("a")).collect()] == ["a\nb", ""]


def chat_stub(folder, dies_at=None):
    """A model function that notes every request it is asked, and dies at one."""
    def fn(batch):
        import os
        import uuid
        for messages in batch:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as fh:
                fh.write(messages[-1]["content"])
        if dies_at is not None and any(m[-1]["content"] == dies_at for m in batch):
            raise RuntimeError("the service is gone")
        return [(f" re: {m[-1]['content']} ", 3, 2) for m in batch]
    return fn


def test_replies_are_kept_over_a_failure(spark, tmp_path):
    from docweave.operators.prompts import complete_stored
    asked = [f"question number {i % 40}" for i in range(60)]  # twenty are asked twice
    prompts = spark.createDataFrame([(i, [{"role": "user", "content": q}]) for i, q in enumerate(asked)],
                                    "request_id long, messages array<struct<role:string,content:string>>")
    calls, path = tmp_path / "calls", str(tmp_path / "replies")
    calls.mkdir()
    settings = dict(batch_tokens=40, batch_prompts=5, wave_batches=1)
    with pytest.raises(Exception, match="the service is gone"):
        complete_stored(prompts, "request_id", chat_stub(str(calls), "question number 7"), "m", path, **settings)
    done = {r.reply for r in spark.read.parquet(path + "/replies").collect()}
    before = [f.read_text() for f in calls.iterdir()]
    assert 0 < len(done) < 40
    got = complete_stored(prompts, "request_id", chat_stub(str(calls)), "m", path, **settings).collect()
    assert sorted((r.request_id, r.reply) for r in got) == [(i, f"re: {q}") for i, q in enumerate(asked)]
    counts = {}
    for f in calls.iterdir():
        counts[f.read_text()] = counts.get(f.read_text(), 0) + 1
    assert set(counts) == set(asked)
    twice = {q for q, n in counts.items() if n > 1}
    assert "question number 7" in twice and len(twice) <= 5  # the open batch
    assert {q for q in before if q not in twice} == {r.removeprefix("re: ") for r in done}
    total = len(list(calls.iterdir()))
    complete_stored(prompts, "request_id", chat_stub(str(calls)), "m", path, **settings).collect()
    assert len(list(calls.iterdir())) == total
    other = complete_stored(prompts.limit(3), "request_id", chat_stub(str(calls)), "other model", path, **settings)
    assert other.count() == 3 and len(list(calls.iterdir())) == total + 3


def test_pairs_of_turns_with_gaps(spark):
    from docweave.operators.prompts import chat_pairs
    turns = [(1, 0, "user", "a"), (1, 5, "assistant", "b"), (1, 6, "user", "c"), (1, 9, "system", "d"),
             (1, 12, "assistant", "e"), (2, 3, "assistant", "f"), (2, 4, "user", "g"), (2, 70, "user", "h"),
             (2, 71, "assistant", None), (3, 1, "user", "i")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.question, r.answer) for r in chat_pairs(df).collect())
    assert got == [(1, 0, "a", "b"), (2, 70, "h", None)]


def test_batches_go_back_to_spark_in_few_frames(spark, monkeypatch):
    """E1 on batch rows: one call for each batch, null names and all, and one frame for many batches."""
    import pyarrow as pa
    from docweave.operators import embedding as E

    rows = [(None if i == 3 else i // 2, "k", i % 2, 5 * (i % 2), [f"line {i} {j}" for j in range(1 + i % 3)]) for i in range(200)]
    batches = spark.createDataFrame(rows, "name long, lang string, batch long, first long, texts array<string>")
    got = E.embed_batches(batches.coalesce(1), 8, python_hashing_embedder(8), keep=("lang",)).collect()
    embed = python_hashing_embedder(8)
    want = [(name, lang, first + j, text, batch, embed([text])[0])
            for name, lang, batch, first, texts in rows for j, text in enumerate(texts)]
    assert sorted(map(str, ((r.name, r.lang, r.pos, r.text, r.batch, r.embedding) for r in got))) == sorted(map(str, want))

    class Batches:  # the function as Spark calls it, on one record batch
        schema = batches.schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            columns = list(zip(*rows))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            return list(run([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                        names=batches.columns)]))

    frames = E.embed_batches(Batches(), 8, embed, keep=("lang",))
    assert sum(f.num_rows for f in frames) == len(want) and len(frames) == -(-len(rows) // E.FRAME_BATCHES)
