"""Sharding down a hierarchical tree of regions, racks and shards by weighted hash draws.

At each level every child of the chosen node draws ``-ln(u) / weight`` with
``u`` uniform from a hash of (key, node), and the smallest draw wins: a child
wins in proportion to its weight, and raising one child's weight only lowers
its own draws.  Keys therefore move only into subtrees whose weight rose (or out
of ones whose weight fell), and stay put everywhere else.  ``grown`` adds a
shard as a region of its own, so that rows move into that shard and nowhere else.

All expressions are DataFrame functions; slots are numbered without gathering
a shard in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import sized, staged

# Rows numbered together; a slot is the count of earlier blocks plus a rank in the block.
BLOCK_ROWS = 50_000


@dataclass(frozen=True)
class Leaf:
    """A shard and its place in the tree."""
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> tuple[Leaf, ...]:
    """Shards 0 .. ``shards - 1`` of weight 1, filled rack by rack and region by region."""
    return tuple(Leaf(s // (racks_per_region * shards_per_rack), s // shards_per_rack, s) for s in range(shards))


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, in a new rack of a new region."""
    new = [max(getattr(leaf, level) for leaf in tree) + 1 for level in ("region", "rack", "shard")]
    return (*tree, Leaf(*new, weight))


def _winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the smallest weighted draw; the smaller id in a tie."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = []
    for node, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{node}")), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.ln(u) / F.lit(weight)).alias("draw"), F.lit(node).alias("node")))
    return F.array_min(F.array(*draws))["node"]


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a key: a region, one of its racks, one of that rack's shards."""
    leaves = [leaf for leaf in tree if leaf.weight > 0]
    if not leaves:
        raise ValueError("a tree needs a shard of positive weight")

    def total(level: str, among: list[Leaf]) -> dict[int, float]:
        out: dict[int, float] = {}
        for leaf in among:
            out[getattr(leaf, level)] = out.get(getattr(leaf, level), 0.0) + leaf.weight
        return out

    def descend(levels: list[str], among: list[Leaf]) -> Column:
        weights = total(levels[0], among)
        chosen = _winner(key, levels[0], weights)
        if len(levels) == 1:
            return chosen
        below = {node: descend(levels[1:], [x for x in among if getattr(x, levels[0]) == node]) for node in weights}
        if len(below) == 1:
            return next(iter(below.values()))
        pick = None
        for node, shard in below.items():
            hit = chosen == node
            pick = F.when(hit, shard) if pick is None else pick.when(hit, shard)
        return pick

    return descend(["region", "rack", "shard"], leaves).cast("int")


def numbered(rows: DataFrame, group: str, slot: str = "slot") -> DataFrame:
    """Staged ``rows`` with a gapless number from 0 in each ``group``, in the order of ``_at``.

    ``_at`` is a stored unique number whose upper bits name the input partition.
    Ranks are taken in blocks of at most ``BLOCK_ROWS`` input rows, and the
    counts of earlier blocks are added; no task holds a whole group.
    """
    keys = [group, "_part", "_block"]
    blocked = (rows.withColumn("_part", F.shiftright("_at", 33))
               .withColumn("_block", F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS)))
    before = Window.partitionBy(group).orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    starts = staged(starts, "slot-starts")
    ranked = blocked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_at")))
    return (ranked.join(sized(starts, 48), keys)
            .withColumn(slot, (F.col("_start") + F.col("_rank") - 1).cast("long"))
            .drop("_part", "_block", "_start", "_rank", "_at"))


def shard_rows(docs: DataFrame, tree: tuple[Leaf, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    The law is ``key``: the id and the tree alone decide the shard, so rows that
    repeat an id share a shard, and all null ids go to one shard.  ``size`` is
    the text's UTF-8 bytes plus 1 (a null text has no bytes and the checksum
    of no bytes, 0).  ``slot`` counts from 0 without gaps in each shard.
    ``grown_shard`` is the shard under ``grown(tree)``: the same, or the new one.
    An empty table gives an empty result; other columns are not read.
    """
    key, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_at"))
    return numbered(staged(rows, "shard-rows"), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
