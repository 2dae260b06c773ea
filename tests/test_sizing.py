"""Broadcast guards and input spreading."""

import contextlib
import io

from pyspark.sql import functions as F

from docweave.plans.sizing import fits, maybe_broadcast, spread


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_fits_needs_a_bound():
    assert not fits(None, 8)
    assert fits(1000, 8, limit=8000)
    assert not fits(1001, 8, limit=8000)


def test_maybe_broadcast_obeys_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(10000).withColumnRenamed("id", "k")
        small = spark.range(10).withColumnRenamed("id", "k")
        assert "BroadcastHashJoin" in plan(big.join(maybe_broadcast(small, 10, 8, limit=1000), "k"))
        assert "BroadcastHashJoin" not in plan(big.join(maybe_broadcast(small, 10, 8, limit=10), "k"))
        assert "BroadcastHashJoin" not in plan(big.join(maybe_broadcast(small, None, 8), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_only_when_too_few_splits(spark):
    many = spark.range(0, 1000, 1, 16)
    assert spread(many, 8) is many
    one = spark.range(0, 1000, 1, 1)
    spread_one = spread(one, 8)
    assert spread_one.rdd.getNumPartitions() == 8
    assert spread_one.agg(F.sum("id")).collect()[0][0] == sum(range(1000))


def test_stored_tables_are_removed_on_request(spark):
    import os
    from docweave.plans import sizing
    sizing.remove_staged(spark)
    paths = [sizing.materialize(spark.range(5), "unit").inputFiles()[0] for _ in range(3)]
    folders = [os.path.dirname(p).removeprefix("file:").replace("//", "/") for p in paths]
    assert all(os.path.isdir(f) for f in folders)
    assert sizing.remove_staged(spark) == 3 and sizing.remove_staged(spark) == 0
    assert not any(os.path.isdir(f) for f in folders)


def test_materialize_uses_session_checkpoint_dir(spark):
    from docweave.plans.sizing import materialize
    from docweave.session import checkpoint_dir
    configured = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == configured
    staged = materialize(spark.range(5), "unit")
    assert staged.count() == 5
    assert all(configured.rstrip("/").removeprefix("file:") in f for f in staged.inputFiles())
