"""Hand-computed micro-fixtures for the behaviours that decide results."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.constants import CHAT_MODELS, DEFAULT_CHAT_MODEL
from docweave.functions.text import clean_lines, token_count
from docweave.operators.cost import chat_cost, model_catalog, unknown_models
from docweave.operators.fragments import (
    fragment_arrays, numbered_list, paragraph_fragments, reflow_lines, rejected_documents,
    split_fragments,
)
from docweave.operators.prompts import assemble_stream, chat_pairs, split_keywords
from docweave.operators.retrieval import new_documents, top_k_cosine, top_k_inner_product, unknown_documents
from docweave.operators.summary import (
    document_frequency, idf, mean_vector, sif_mean_vector, sif_weight,
)
from docweave.operators.tokens import cut_report, cut_to_budget, pack_batches, pack_document_batches

VEC = T.ArrayType(T.FloatType())


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ------------------------------------------------------------ budget cut

@pytest.mark.parametrize("tokens,kept", [
    ([100, 250, 10], [100, 250]),
    ([400, 1], [400]),
    ([300, 1, 1], [300, 1]),
    ([10, 20], [10, 20]),
])
def test_inclusive_budget_cut(spark, tokens, kept):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "key long, rank long, n_tokens long")
    out = cut_to_budget(df, "key", 300).orderBy("rank")
    assert [r.n_tokens for r in out.collect()] == kept
    rep = cut_report(df, "key", 300).collect()[0]
    assert rep.kept == len(kept) and rep.was_cut == (len(kept) < len(tokens))


def test_budget_cut_empty(spark):
    df = spark.createDataFrame([], "key long, rank long, n_tokens long")
    assert cut_to_budget(df, "key", 300).count() == 0


# ------------------------------------------------------------ packing

PACK_CASES = [
    ([100, 250, 10, 301, 5], [0, 0, 1, 1, 2]),
    ([300], [0]),
    ([301, 1], [0, 1]),
    ([301], [0]),
]


@pytest.mark.parametrize("tokens,batches", PACK_CASES)
def test_pack_table_form(spark, tokens, batches):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(tokens)], "name string, pos long, n_tokens long")
    out = pack_batches(df, 1324).orderBy("pos")
    assert [r.batch for r in out.collect()] == batches


@pytest.mark.parametrize("tokens,batches", PACK_CASES)
def test_pack_document_form(spark, tokens, batches):
    text = "\n".join(" ".join(["a"] * t) for t in tokens)
    docs = fragment_arrays(spark.createDataFrame([("d", text)], "name string, text string"))
    out = pack_document_batches(docs, 1324).orderBy("pos")
    got = out.collect()
    assert [r.n_tokens for r in got] == tokens
    assert [r.batch for r in got] == batches


def test_pack_empty_document(spark):
    docs = fragment_arrays(spark.createDataFrame([("d", "  \n \n")], "name string, text string"))
    assert pack_document_batches(docs, 1324).count() == 0


# ------------------------------------------------------------ splitting, reflow, paragraphs

def test_unicode_split_and_trim(spark):
    text = "　a\xa0 b\x1c c\x85d\r\ne\x0bf\x0cg "
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(clean_lines(F.col("text")).alias("l")).collect()[0].l
    assert got == ["a\xa0 b", "c", "d", "e", "f", "g"]
    assert got == [s.strip() for s in text.splitlines() if s.strip()]


def test_split_fragments_positions(spark):
    df = spark.createDataFrame([(7, "one\n\n  two  \nthree")], "name long, text string")
    assert rows(split_fragments(df).orderBy("pos"), "pos", "text") == [(0, "one"), (1, "two"), (2, "three")]


def test_reflow_page_flush(spark):
    lines = [(1, 1, 0, "The cat"), (1, 1, 1, "sat."), (1, 1, 2, "It"),
             (1, 2, 0, "slept!"), (1, 2, 1, "  "), (1, 2, 2, "End")]
    df = spark.createDataFrame(lines, "name long, page long, pos long, text string")
    out = reflow_lines(df).orderBy("pos")
    assert rows(out, "pos", "text") == [(0, "The catsat."), (1, "It"), (2, "slept!"), (3, "End")]


def test_paragraph_renumbering(spark):
    df = spark.createDataFrame([(1, 0, " a "), (1, 3, "   "), (1, 5, "b"), (2, 9, "c")],
                               "name long, pos long, text string")
    assert sorted(rows(paragraph_fragments(df), "name", "pos", "text")) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_rejected_blank_document(spark):
    df = spark.createDataFrame([(1, " \n\t\n"), (2, "x")], "name long, text string")
    assert rows(rejected_documents(df), "name") == [(1,)]


def test_numbered_list_from_zero(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b")], "k long, rank long, label string")
    assert numbered_list(df, "k").collect()[0].numbered == "0. a\n1. b\n2. c"


def test_token_count_rules(spark):
    df = spark.createDataFrame([("Hello, world 12345!",), ("",)], "t string")
    # Hello | , | world | 123 | 45 | !
    assert [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()] == [6, 0]


# ------------------------------------------------------------ SIF and means

def sif_frags(spark):
    data = [("d", 0, "alpha beta", [1.0, 0.0]), ("d", 1, "alpha Gamma", [0.5, 0.5]),
            ("d", 2, "delta.", [0.0, 2.0])]
    return spark.createDataFrame(data, T.StructType([
        T.StructField("name", T.StringType()), T.StructField("pos", T.LongType()),
        T.StructField("text", T.StringType()), T.StructField("embedding", VEC)]))


def test_sif_centroid(spark):
    frags = sif_frags(spark)
    idf_t = idf(document_frequency(frags), frags)
    idfs = {r.term: round(r.idf, 6) for r in idf_t.collect()}
    assert idfs == {"alpha": 1.287682, "beta": 1.693147, "gamma": 1.693147, "delta": 1.693147}
    weighted = sif_weight(frags, idf_t)
    w = {r.pos: round(r.weight, 9) for r in weighted.collect()}
    assert w == {0: 0.001366254, 1: 0.000775987, 2: 0.0}
    c = sif_mean_vector(weighted).collect()[0].centroid
    assert [round(x, 6) for x in c] == [0.665953, 0.666408]
    m = mean_vector(frags).collect()[0].centroid
    assert [round(x, 6) for x in m] == [0.5, 0.833333]


def test_sif_counts_zero_maximum(spark):
    """A zero vector adds nothing to the sum; the mean is over all fragments."""
    data = [("d", 0, "alpha", [0.0, 0.0]), ("d", 1, "beta", [2.0, 0.0])]
    frags = spark.createDataFrame(data, "name string, pos long, text string, embedding array<float>")
    weighted = sif_weight(frags, idf(document_frequency(frags), frags))
    c = sif_mean_vector(weighted).collect()[0].centroid
    assert c[1] == 0.0 and 0.495 < c[0] < 0.5


# ------------------------------------------------------------ top-k

def topk_inputs(spark):
    q = spark.createDataFrame([(1, "d", [1.0, 0.0])], "request_id long, name string, embedding array<float>")
    idx = spark.createDataFrame([("d", 0, [0.9, 0.1]), ("d", 1, [3.0, 3.0]), ("d", 2, [0.0, 0.0])],
                                "name string, pos long, embedding array<float>")
    return q, idx


def test_inner_product_vs_cosine(spark):
    q, idx = topk_inputs(spark)
    ip = top_k_inner_product(q, idx, query_rows=1, dim=2).orderBy("rank")
    rounded = lambda df, col: [(p, None if x is None else round(x, 6)) for p, x in rows(df, "pos", col)]
    assert rounded(ip, "score") == [(1, 3.0), (0, 0.9), (2, 0.0)]
    cos = top_k_cosine(q, idx, query_rows=1, dim=2).orderBy("rank")
    assert rounded(cos, "distance") == [(0, round(1 - 0.993884, 6)), (1, round(1 - 0.707107, 6)), (2, None)]


def test_topk_ties_limit_and_other_documents(spark):
    q = spark.createDataFrame([(1, "d", [1.0])], "request_id long, name string, embedding array<float>")
    idx = spark.createDataFrame([("d", 5, [1.0]), ("d", 2, [1.0]), ("e", 0, [9.0])],
                                "name string, pos long, embedding array<float>")
    out = top_k_inner_product(q, idx, limit=10, query_rows=1, dim=1).orderBy("rank")
    assert rows(out, "pos", "rank") == [(2, 0), (5, 1)]
    assert top_k_inner_product(q, idx, limit=1).count() == 1


# ------------------------------------------------------------ existence, duplicates, unknown

def test_new_documents_dedupes_and_skips_indexed(spark):
    docs = spark.createDataFrame([("h1", 3), ("h1", 1), ("h2", 2), ("h3", 4)], "content_id string, doc_id long")
    index = spark.createDataFrame([("h3", 0)], "name string, pos long")
    assert sorted(rows(new_documents(docs, index), "content_id", "doc_id")) == [("h1", 1), ("h2", 2)]


def test_unknown_documents(spark):
    req = spark.createDataFrame([("r1", "a"), ("r2", "zz")], "request_id string, name string")
    index = spark.createDataFrame([("a", 0), ("a", 1)], "name string, pos long")
    assert rows(unknown_documents(req, index), "request_id") == [("r2",)]


# ------------------------------------------------------------ cost, models

def test_chat_cost(spark):
    chat, _ = model_catalog(spark)
    usage = spark.createDataFrame([(1, "gpt-3.5-turbo", 2000, 1000)],
                                  "call_id long, model string, prompt_tokens long, completion_tokens long")
    r = chat_cost(usage, chat).collect()[0]
    assert (r.input_cost, r.output_cost, r.total_cost, r.total_tokens) == (0.001, 0.0015, 0.0025, 3000)
    assert {m[0] for m in CHAT_MODELS} >= {DEFAULT_CHAT_MODEL}


def test_unknown_model(spark):
    chat, _ = model_catalog(spark)
    usage = spark.createDataFrame([("gpt-4",), ("no-such-model",)], "model string")
    assert rows(unknown_models(usage, chat), "model") == [("no-such-model",)]


# ------------------------------------------------------------ stream assembly, chat

def test_assemble_stream_out_of_order(spark):
    chunks = spark.createDataFrame([(1, 2, "lo "), (1, 0, " Hel"), (1, 1, None)],
                                   "reply_id long, seq long, delta string")
    assert assemble_stream(chunks).collect()[0].reply == "Hello"


def test_chat_pairs(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2")], "conv_id long, turn long, role string, text string")
    assert rows(chat_pairs(conv), "turn", "question", "answer") == [(1, "q1", "a1")]


def test_split_keywords(spark):
    df = spark.createDataFrame([("a, b ,c",)], "kw string")
    assert df.select(split_keywords(F.col("kw")).alias("k")).collect()[0].k == ["a", "b", "c"]


def test_published_batch_shape(spark):
    """Full batches close just above 8191 - 1024 = 7167 tokens; the last one is below."""
    from conftest import SMOKE
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").limit(60)
    text = "\n".join(r.text for r in docs.collect())
    packed = pack_document_batches(fragment_arrays(
        spark.createDataFrame([("novel", text)], "name string, text string")), 8191)
    totals = sorted((r.batch, r.tokens) for r in packed.groupBy("batch").agg(
        F.sum("n_tokens").alias("tokens")).collect())
    assert len(totals) > 2
    assert all(t > 7167 for _, t in totals[:-1])
    assert totals[-1][1] <= 7167 or len(totals) == 1


def test_language_detection_held_out(spark):
    """Train on half of the distinct contents, detect the other half (split by fingerprint)."""
    from docweave.operators.identity import content_id_of_text
    from docweave.operators.language import detect_language, language_profiles
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn(
        "cid", content_id_of_text(F.col("text")))
    side = F.conv(F.substring("cid", 1, 2), 16, 10).cast("int") % 2
    train, held = docs.filter(side == 0), docs.filter(side == 1)
    prof = language_profiles(train)
    got = detect_language(held.select("doc_id", "text"), prof, ["doc_id"], profile_rows=prof.count())
    joined = got.join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    total = held.count()
    right = joined.filter(F.col("lang") == F.col("truth")).count()
    assert total > 300 and right / total > 0.97


# ---------------------------------------------------------------- nothing is lost


def test_ranking_uses_more_than_six_decimals(spark):
    idx = spark.createDataFrame([("d", 0, [0.5]), ("d", 1, [0.5000003])], "name string, pos long, embedding array<double>")
    q = spark.createDataFrame([("r", "d", [1.0])], "request_id string, name string, embedding array<double>")
    assert top_k_inner_product(q, idx, limit=1).collect()[0].pos == 1


def test_every_question_has_a_row(spark):
    from docweave.plans.answer import answer_context
    frags = spark.createDataFrame([("d", 0, "alpha beta gamma"), ("d", 1, "delta epsilon")],
                                  "name string, pos long, text string")
    many = " ".join(f"w{k}" for k in range(20)) + " delta alpha"
    req = spark.createDataFrame([("r1", "d", "where is delta"), ("r2", "d", "zeta eta"), ("r3", "nowhere", "alpha"),
                                 ("r4", "d", "??"), ("r5", "d", many)], "request_id string, name string, query string")
    got = {r.request_id: r for r in answer_context(req, frags, 32, request_rows=5).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "r1": "answered", "r2": "no match", "r3": "unknown document", "r4": "no match", "r5": "answered"}
    assert got["r2"].keywords == "eta,zeta" and got["r4"].keywords == "" and got["r4"].n_fragments == 2
    assert got["r3"].context is None and got["r5"].keywords == "alpha,delta"
    cosine = answer_context(req, frags, 32, request_rows=5, cosine=True)
    assert cosine.count() == 5


def test_every_text_gets_a_language(spark):
    from docweave.operators.language import detect_language, language_profiles
    prof = language_profiles(spark.createDataFrame(
        [("en", "the cat and the dog"), ("en", "this is the house"), ("fr", "le chat et la maison")],
        "lang string, text string"))
    texts = spark.createDataFrame([(1, "the house"), (2, "la maison"), (3, "12345"), (4, "中文字符"), (5, None), (6, "")],
                                  "id long, text string")
    got = {r.id: r.lang for r in detect_language(texts, prof, ["id"], profile_rows=prof.count()).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6}
    assert got[1] == "en" and got[2] == "fr" and got[3] == got[5] == got[6] == "en"


def test_zero_vectors_count_in_the_mean(spark):
    from docweave.operators.summary import centrality
    df = spark.createDataFrame([("d", 0, [2.0, 0.0], 0.0), ("d", 1, [0.0, 0.0], 0.0), ("e", 0, [0.0, 0.0], 0.0)],
                               "name string, pos long, embedding array<double>, weight double")
    cents = sif_mean_vector(df)
    assert {r.name: list(r.centroid) for r in cents.collect()} == {"d": [0.5, 0.0], "e": [0.0, 0.0]}
    assert centrality(df, cents).count() == 3


def test_usage_of_an_unknown_model_is_kept(spark):
    chat, _ = model_catalog(spark)
    usage = spark.createDataFrame([("gpt-4", 1000, 0), ("other", 10, 5)],
                                  "model string, prompt_tokens long, completion_tokens long")
    got = {r.model: (r.known_model, r.total_tokens, r.total_cost) for r in chat_cost(usage, chat).collect()}
    assert got == {"gpt-4": (True, 1000, 0.03), "other": (False, 15, None)}
    with pytest.raises(Exception, match="unknown model"):
        chat_cost(usage.drop("model"), chat, model="nope").collect()


def test_null_text_is_rejected(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, " ")], "name long, text string")
    assert sorted(r.name for r in rejected_documents(df).collect()) == [1, 3]


def test_embedding_totals(spark):
    from docweave.operators.cost import embedding_cost, embedding_cost_totals
    _, models = model_catalog(spark)
    batches = spark.createDataFrame([("a", 0, 1000), ("a", 1, 500), ("b", 0, 2000)], "name string, batch long, tokens long")
    got = {r.name: (r.tokens, r.batches, r.cost) for r in embedding_cost_totals(
        embedding_cost(batches, models, "text-embedding-ada-002")).collect()}
    assert got == {"a": (1500, 2, 0.00015), "b": (2000, 1, 0.0002), None: (3500, 3, 0.00035)}


def test_embedder_of_another_length_fails(spark):
    from docweave.operators.embedding import embed_fragments
    df = spark.createDataFrame([("d", 0, "a", 0), ("d", 1, "b", 0)], "name string, pos long, text string, batch long")
    with pytest.raises(Exception, match="vectors of length 4"):
        embed_fragments(df, 4, embedder=lambda texts: [[0.0] * 3 for _ in texts]).collect()


def test_both_packings_agree(spark):
    lines = [" ".join(["w"] * (1 + (7 * k) % 23)) for k in range(60)]
    docs = spark.createDataFrame([("d", lines), ("e", ["one"]), ("f", [])], "name string, fragments array<string>")
    whole = pack_document_batches(docs, 50, reserve=10)
    frags = whole.drop("batch")
    key = lambda df: sorted((r.name, r.pos, r.n_tokens, r.batch) for r in df.collect())
    assert key(whole) == key(pack_batches(frags, 50, reserve=10))
    run, batch, want = 0, 0, []
    for r in sorted(frags.filter("name = 'd'").collect(), key=lambda r: r.pos):
        want.append(batch)
        run += r.n_tokens
        if run > 40:
            run, batch = 0, batch + 1
    assert [b for n, _, _, b in key(whole) if n == "d"] == want


def test_entities_and_side_blocks(spark):
    from docweave.sources.html import html_text
    pages = {"<p>it&#39;s&nbsp;a &#8212; b &#x1F600; &amp;#39; &#0; &#9999999;</p>":
             "it's a — b 😀 &#39; &#0; &#9999999;",
             '<div class="ad">buy</div><p>text</p>': "text",
             "<section id='x' class='promo big'>buy</section><p>more</p>": "buy\n\nmore"}
    df = spark.createDataFrame([(k,) for k in pages], "h string")
    got = {r.h: r.t.strip(" \n") for r in df.select("h", html_text(F.col("h")).alias("t")).collect()}
    assert got == pages
    other = df.select("h", html_text(F.col("h"), side_classes=("ad", "promo")).alias("t")).collect()
    assert "more" in [r.t.strip(" \n") for r in other]


def test_row_wise_cut_equals_the_window_form(spark):
    from docweave.operators.tokens import cut_document_report, cut_documents, document_batches
    lines = [" ".join(["w"] * (1 + (5 * k) % 17)) for k in range(40)]
    docs = spark.createDataFrame([("d", lines), ("e", ["one two"]), ("f", [])], "name string, fragments array<string>")
    ranked = docs.select("name", F.posexplode("fragments").alias("pos", "text")).withColumn(
        "n_tokens", token_count(F.col("text")))
    for budget in (0, 60, 10_000):
        key = lambda df: sorted((r.name, r.pos, r.n_tokens) for r in df.collect())
        assert key(cut_documents(docs, budget)) == key(cut_to_budget(ranked, "name", budget, rank="pos"))
        rep = lambda df: sorted((r.name, r.candidates, r.kept, r.kept_tokens, r.was_cut) for r in df.collect())
        assert rep(cut_document_report(docs, budget)) == rep(cut_report(ranked, "name", budget, rank="pos"))
    packed = {(r.name, r.pos): r.batch for r in pack_document_batches(docs, 50, reserve=10).collect()}
    rows_ = document_batches(docs, 50, reserve=10).collect()
    assert {(r.name, r.first + k): r.batch for r in rows_ for k in range(len(r.texts))} == packed
