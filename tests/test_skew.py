"""Hot keys: results stay exact when one key holds a large share of all rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators.retrieval import dedupe_documents, top_k_inner_product
from docweave.plans.scan import dense_positions


def test_chunked_numbering_spans_chunks(spark):
    # one hot name with 1,000 rows over 50 chunks, plus a few cold names; gaps in positions
    hot = spark.range(1000).select(F.lit("hot").alias("name"), (F.col("id") * 3).alias("src"))
    cold = spark.range(30).select((F.col("id") % 3).cast("string").alias("name"), F.col("id").alias("src"))
    out = dense_positions(hot.unionByName(cold), "name", "src", chunk_rows=60)
    got = {(r.name, r.src): r.pos for r in out.collect()}
    assert [got[("hot", 3 * i)] for i in range(1000)] == list(range(1000))
    for n in "012":
        srcs = sorted(s for (k, s) in got if k == n)
        assert [got[(n, s)] for s in srcs] == list(range(len(srcs)))


def test_hot_duplicate_group_reduced_map_side(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("content_id"),
        (3000 - F.col("id")).alias("doc_id"))
    out = dedupe_documents(docs.repartition(8))
    assert out.count() == 2001
    assert out.filter("content_id = 'same'").collect()[0].doc_id == 3
    import contextlib, io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    plan = buf.getvalue()
    # partial aggregation happens before the exchange
    assert plan.index("partial_min") > plan.index("Exchange")


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=40),
       st.integers(1, 50))
def test_top_k_is_prefix_of_full_sort(spark, vecs, limit):
    q = spark.createDataFrame([(1, "d", [1.0, 0.5])], "request_id long, name string, embedding array<float>")
    idx = spark.createDataFrame([("d", i, [float(a), float(b)]) for i, (a, b) in enumerate(vecs)],
                                "name string, pos long, embedding array<float>")
    got = [(r.pos, r.score) for r in top_k_inner_product(q, idx, limit, 1, 2).orderBy("rank").collect()]
    full = sorted(((i, round(a * 1.0 + b * 0.5, 6)) for i, (a, b) in enumerate(vecs)), key=lambda t: (-t[1], t[0]))
    assert got == full[:limit]


def test_chunked_running_total_matches_window(spark):
    from pyspark.sql import Window
    from docweave.plans.scan import running_total
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, F.lit("hot")).otherwise((F.col("id") % 4).cast("string")).alias("k"),
        (F.col("id") * 2).alias("o"), (F.col("id") % 7).alias("v"))
    chunked = running_total(df, ["k"], "o", F.col("v"), "before", chunk_rows=37)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0)))
    a = sorted(tuple(r) for r in chunked.select("k", "o", "before").collect())
    b = sorted(tuple(r) for r in plain.select("k", "o", "before").collect())
    assert a == b


def test_a_hot_turn_of_many_lines_is_cut_by_all_order_columns(spark):
    from docweave.plans.scan import chunked
    hot = spark.range(0, 200_000, 1, 4).select(F.lit(1).alias("name"), F.lit(7).alias("turn"), F.col("id").alias("line"))
    cold = spark.range(500).select((2 + F.col("id") % 9).cast("int").alias("name"), F.lit(0).alias("turn"),
                                   (F.col("id") * 5).alias("line"))
    parts = chunked(hot.unionByName(cold), ["name"], ["turn", "line"])
    sizes = [r["count"] for r in parts.filter("name = 1").groupBy("_chunk").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 20_000
    out = dense_positions(hot.unionByName(cold), "name", "turn", extra_order=["line"])
    assert out.filter("name = 1 AND pos <> line").count() == 0
    seen = out.filter("name > 1").groupBy("name").agg(F.min("pos").alias("a"), F.max("pos").alias("b"),
                                                      F.countDistinct("pos").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in seen)


def test_sentences_across_chunk_borders_are_stitched(spark, monkeypatch):
    from docweave.operators import fragments
    from docweave.plans import scan
    real = scan.running_total
    monkeypatch.setattr(fragments, "running_total", lambda *a, **k: real(*a, chunk_rows=17, **k))
    lines, want, glued = [], [], ""
    for i in range(900):
        text = f"l{i}." if i % 31 == 30 or i > 850 else f"l{i}"
        lines.append(("d", 3, i, f" {text} "))
        glued += text
        if text.endswith("."):
            want.append(glued)
            glued = ""
    lines += [("d", 4, 0, "next page"), ("e", 3, 5, "other")]
    df = spark.createDataFrame(lines, "name string, page long, pos long, text string").repartition(4)
    got = fragments.reflow_lines(df).orderBy("name", "pos").collect()
    assert [r.text for r in got] == [*want, "next page", "other"]
    assert [r.pos for r in got] == [*range(len(want) + 1), 0]


def test_terms_are_counted_without_a_table_before_the_shuffle(spark):
    """The terms one task counts follow the number of fragments, not the size of the files it reads."""
    from docweave.operators.summary import COUNTED_FRAGMENTS, document_frequency

    rows = [("a", 0, "one two one"), ("a", 1, "two three"), ("b", 0, "two"), (None, 0, "one"), ("a", 1, "two three")]
    frags = spark.createDataFrame(rows, "name string, pos long, text string")
    plain = document_frequency(frags)
    dealt = document_frequency(frags, 20 * COUNTED_FRAGMENTS)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    physical = dealt._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in physical and physical.index("partial_count") < physical.index("Exchange")


def test_documents_asked_about_are_dealt_over_tasks(spark, tmp_path):
    """They may lie together in one file of the table: their stored fragments do not."""
    import random

    from docweave.plans.registry import requested_fragments

    rnd = random.Random(5)
    docs = [(i, "\n".join(f"{rnd.getrandbits(400):x}" for _ in range(20)), "en", "s") for i in range(8000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartitionByRange(
        8, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, "user", f"line {i}") for i in range(900)],
                          "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    _, frags, _ = requested_fragments(spark, str(tmp_path))
    per_file = [r["count"] for r in frags.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 900 * 20 and frags.select("name").distinct().count() == 900
    assert len(per_file) > 1 and max(per_file) < 0.8 * sum(per_file)


def test_the_stored_index_holds_no_terms(spark):
    from conftest import SMOKE
    from docweave.plans.registry import sif_fragments

    assert sif_fragments(spark, SMOKE).columns == ["name", "lang", "pos", "text", "embedding"]


def test_terms_are_dealt_once_for_the_keywords(spark, monkeypatch):
    """Counts too many to broadcast meet the fragments, not the table of terms: its tasks follow the fragments to the end."""
    from docweave.operators import summary
    from docweave.operators.retrieval import extract_keywords
    from docweave.plans.answer import dealt_keywords

    rows = [("a", 0, "one two one"), ("a", 1, "two three"), ("b", 0, "two"), (None, 0, "one"), ("a", 1, "two three"),
            ("a", 700, "four")]
    frags = spark.createDataFrame(rows, "name string, pos long, text string")
    asked = [("q", "a", "three two two five"), ("q", "a", "one"), ("r", "b", "one"), ("s", None, "one"), ("t", "a", "?"),
             ("u", "c", "six six five")]
    req = spark.createDataFrame(asked, "request_id string, name string, query string")
    plain = extract_keywords(req, summary.idf(summary.document_frequency(frags), frags))
    monkeypatch.setattr(summary, "maybe_broadcast", lambda df, *_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = dealt_keywords(req, frags, 20 * summary.COUNTED_FRAGMENTS)
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
        assert summary.dealt_idf(frags, 20 * summary.COUNTED_FRAGMENTS).rdd.getNumPartitions() == 20
        physical = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        # questions' terms, fragments' terms, pieces of documents
        assert physical.count(", 20), REPARTITION_BY_NUM") == 3 and ", 20), ENSURE_REQUIREMENTS" not in physical
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
