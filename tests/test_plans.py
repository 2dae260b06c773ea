"""Physical-plan checks: the plans we want, not just the right rows."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from docweave.operators.retrieval import top_k_inner_product
from docweave.plans.registry import QUERIES
from docweave.sources.index import read_index, write_index

# Evaluation, map, group, window and aggregate nodes alike.
PY_NODES = ("EvalPython", "InPandas", "InArrow", "WindowPython", "AggregatePython")
# Queries that run a caller-supplied Python function on purpose.
PYTHON_HOOKS = {"embed_fragments"}


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMOKE))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_HOOKS:
        assert not any(node in text for node in PY_NODES), name


@pytest.mark.parametrize("name", ["top_k_inner_product", "top_k_cosine", "answer_context", "context_preview"])
def test_partial_top_k_before_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMOKE))
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("name", ["sif_weight", "sif_mean_vector", "centrality", "central_fragments",
                                  "summary_context"])
def test_documents_of_one_row_are_not_shuffled(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SMOKE))


def test_query_side_is_broadcast(spark):
    q = spark.createDataFrame([(1, "d0", [1.0])], "request_id long, name string, embedding array<float>")
    idx = spark.range(1000).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("name"),
                                   F.col("id").alias("pos"),
                                   F.array(F.col("id").cast("float")).alias("embedding"))
    text = plan(top_k_inner_product(q, idx, query_rows=1, dim=1))
    assert "BroadcastHashJoin" in text
    # the broadcast side is the one holding the query vectors
    tree = text.split("\n\n")[0]
    build = tree.split("BroadcastExchange")[1]
    assert "Range" not in build and ("LocalTableScan" in build or "Scan ExistingRDD" in build)


def test_read_index_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i, f"t{i}", [float(i)]) for i in range(50)],
                               "name long, pos long, text string, embedding array<float>")
    path = str(tmp_path / "index")
    write_index(df, path, shards=8)
    sel = read_index(spark, path, names=[3])
    text = plan(sel)
    assert "PartitionFilters: [isnotnull(shard" in text and "shard#" in text
    assert sorted(r.pos for r in sel.collect()) == [i for i in range(50) if i % 7 == 3]
