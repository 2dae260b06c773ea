from collections import defaultdict

from pyspark.sql import functions as F

from docweave.llm.sharding import Leaf, balanced, grown, shard_of, shard_rows


def placed(spark, tree, n=20_000):
    return [r.s for r in spark.range(n).select(shard_of(F.col("id"), tree).alias("s")).collect()]


def test_shares_follow_weights(spark):
    tree = (Leaf(0, 0, 0, 3.0), Leaf(0, 1, 1, 1.0), Leaf(1, 2, 2, 2.0), Leaf(1, 3, 3, 0.0))
    found = placed(spark, tree)
    share = [found.count(s) / len(found) for s in range(4)]
    assert all(abs(a - b) < 0.02 for a, b in zip(share, [1 / 2, 1 / 6, 1 / 3, 0]))


def test_growth_moves_rows_only_into_the_new_shard(spark):
    for shards in (1, 5, 16):
        before, after = placed(spark, balanced(shards)), placed(spark, grown(balanced(shards)))
        moved = [b for a, b in zip(before, after) if a != b]
        assert set(moved) == {shards}
        assert abs(len(moved) / len(before) - 1 / (shards + 1)) < 0.03


def test_a_changed_weight_moves_rows_only_into_or_inside_its_subtree(spark):
    tree = balanced(16)
    heavier = tuple(Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else x.weight) for x in tree)
    region = {x.shard: x.region for x in tree}
    for a, b in zip(placed(spark, tree), placed(spark, heavier)):
        assert a == b or region[b] == region[5]


def test_rows(make_docs, odd_rows):
    import zlib
    rows = shard_rows(make_docs(odd_rows), balanced(16)).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    slots, shard = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_over_many_blocks(spark, monkeypatch):
    from docweave.llm import sharding
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    docs = spark.range(0, 2000, 1, 9).select((F.col("id") % 50).alias("doc_id"), F.lit("t").alias("text"))
    slots = defaultdict(list)
    for r in shard_rows(docs, balanced(3)).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 2000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(make_docs):
    assert shard_rows(make_docs([]), balanced(16)).count() == 0
