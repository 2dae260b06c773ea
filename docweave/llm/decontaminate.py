"""Benchmark passages in training text: BM25 index of test items, block-max WAND, overlap check.

Test items are indexed in blocks of bounded number and size, weighted by counts
over the whole benchmark; each block's inverted index is broadcast and every passage (overlapping word windows of every whole
text) queries it.  An item's BM25 weights are divided by its score against
itself, so a passage's score is the share of the item's weight that it holds
and one threshold serves all items.  All items at or above the threshold are
retrieved, then confirmed by n-gram overlap with the question part and the answer part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import map_batches, packed, sized, staged

K1, B = 1.2, 0.75
BLOCK = 64                 # postings that share one maximum
RARE_SHARE = 0.6           # of an item's weight that its rare terms hold
_FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else (c if c >= 128 else 32) for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other bytes above 127."""
    return text.translate(_FOLD).split()


class Postings:
    """One term's items in order, with the largest weight of each block of ``BLOCK``."""

    __slots__ = ("items", "weights", "largest", "block_ends", "block_max")

    def __init__(self, entries: list[tuple[int, float]]):
        entries.sort()
        self.items = [i for i, _ in entries]
        self.weights = [w for _, w in entries]
        self.largest = max(self.weights)
        self.block_ends = [self.items[min(k + BLOCK, len(entries)) - 1] for k in range(0, len(entries), BLOCK)]
        self.block_max = [max(self.weights[k:k + BLOCK]) for k in range(0, len(entries), BLOCK)]

    def block_of(self, item: int) -> int:
        return bisect_left(self.block_ends, item)


@dataclass(frozen=True)
class Benchmark:
    """Counts over all test items with a term, which the weights of every block follow."""
    items: int
    terms: int                 # of all items together
    longest: int               # terms of the longest item
    holders: dict[bytes, int]  # items that hold a term; of a block's terms at least


class ItemIndex:
    """Inverted index of test items (id, text) with self-normalised BM25 weights.

    ``whole`` are counts over the whole benchmark of which ``items`` are a block;
    without it they are the whole.
    An item's rare terms are those in the fewest items, longer ones first; which
    terms they are decides the work, never what is found.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Benchmark | None = None):
        self.items = []
        for item_id, text in items:
            terms = terms_of((text or "").encode())
            if terms:
                self.items.append((item_id, text, terms))
        counts = [Counter(terms) for _, _, terms in self.items]
        own = Counter(t for c in counts for t in c)
        if whole is None:
            whole = Benchmark(len(self.items), sum(len(t) for _, _, t in self.items),
                              max([0, *(len(t) for _, _, t in self.items)]), own)
        n, df, mean = whole.items, whole.holders, whole.terms / max(1, whole.items)
        self.term_ids = {t: k for k, t in enumerate(own)}
        entries: list[list] = [[] for _ in own]
        self.rare: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.missing: list[float] = []   # weight of each item outside its rare terms
        for i, c in enumerate(counts):
            length = K1 * (1 - B + B * len(self.items[i][2]) / mean)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + length)
                   for t, f in c.items()}
            own, held = sum(raw.values()), 0.0
            for t in sorted(raw, key=lambda t: (df[t], -len(t), t)):
                w = raw[t] / own
                entries[self.term_ids[t]].append((i, w))
                if held < RARE_SHARE:
                    self.rare[self.term_ids[t]].append((i, w))
                    held += w
            self.missing.append(1 - held)
        self.postings = [Postings(e) for e in entries]
        self.window = max(64, 2 * whole.longest)

    def retrieve(self, query: set[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that reach the threshold, by block-max WAND."""
        lists = [self.postings[t] for t in query]
        at = [0] * len(lists)
        live, found, eps = list(range(len(lists))), [], 1e-9

        def advance(k: int, item: int) -> None:
            at[k] = bisect_left(lists[k].items, item, at[k])

        while True:
            live = [k for k in live if at[k] < len(lists[k].items)]
            live.sort(key=lambda k: lists[k].items[at[k]])
            bound, pivot = 0.0, None
            for p, k in enumerate(live):
                bound += lists[k].largest
                if bound >= threshold - eps:
                    pivot = p
                    break
            if pivot is None:
                return found
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            upto = live[:pivot + 1]
            blocks = [lists[k].block_of(item) for k in upto]
            if sum(lists[k].block_max[b] for k, b in zip(upto, blocks) if b < len(lists[k].block_max)) < threshold - eps:
                # no item up to the first block's end can reach the threshold
                ends = [lists[k].block_ends[b] + 1 for k, b in zip(upto, blocks) if b < len(lists[k].block_ends)]
                after = [lists[live[pivot + 1]].items[at[live[pivot + 1]]]] if pivot + 1 < len(live) else []
                target = max(item + 1, min([*ends, *after])) if ends or after else item + 1
                for k in upto:
                    advance(k, target)
            elif lists[upto[0]].items[at[upto[0]]] == item:
                score = 0.0
                for k in upto:
                    if lists[k].items[at[k]] == item:
                        score += lists[k].weights[at[k]]
                        at[k] += 1
                if score >= threshold - eps:
                    found.append((item, score))
            else:
                for k in upto:
                    advance(k, item)

    def passages(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Windows (start, end) of a text's term ids whose upper bound reaches the threshold for some item.

        The bound of an item is the weight of its rare terms that are present
        plus all weight outside them; windows without rare terms end here.
        """
        n, size = len(ids), self.window
        step = size // 2
        held: dict[tuple[int, int], set[int]] = {}
        for p in np.flatnonzero(ids >= 0).tolist():
            entries = self.rare.get(int(ids[p]))
            if entries:
                for w in {p // step, max(0, p // step - 1)}:
                    for i, _ in entries:
                        held.setdefault((w, i), set()).add(int(ids[p]))
        weight = {(t, i): w for t in {t for s in held.values() for t in s} for i, w in self.rare[t]}
        open_ = {w for (w, i), terms in held.items()
                 if sum(weight[t, i] for t in terms) + self.missing[i] >= threshold - 1e-9}
        return [(w * step, min(n, w * step + size)) for w in sorted(open_)]


def overlap(needle: list[bytes], hay: list[bytes], n: int) -> float:
    """Share of the needle's n-grams (all of it, if shorter) that the hay holds; 1 for an empty needle."""
    n = min(n, len(needle))
    if not n:
        return 1.0
    grams = {tuple(needle[i:i + n]) for i in range(len(needle) - n + 1)}
    there = {tuple(hay[i:i + n]) for i in range(len(hay) - n + 1)}
    return len(grams & there) / len(grams)


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Terms of an item's question (all but the last sentence) and answer (the last sentence)."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if terms_of(p.encode())]
    return terms_of(" ".join(parts[:-1]).encode()), terms_of((parts[-1] if parts else "").encode())


_LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()),
                       T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
                       T.StructField("answer_overlap", T.DoubleType()), T.StructField("text_key", T.LongType())])


_ITEM_TERMS = T.StructType([T.StructField("i", T.LongType()), T.StructField("term", T.BinaryType()),
                            T.StructField("n", T.LongType())])


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int, item_col: str, text_col: str):
    """(items, counts of the whole benchmark) for each block of at most ``block_items`` items and ``block_bytes`` text.

    Terms are counted over all items on Spark; a block gets the counts of its own terms.
    """
    items = staged(benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).dropna()
                   .distinct(), "test-items")
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if size[0] <= block_items and size[1] <= block_bytes:
        yield [(r["i"], r["t"]) for r in items.collect()], None
        return
    # Blocks by hash at half the size: none exceeds the bound but by extreme chance, and then it is only larger.
    blocks = max(-(-2 * size[0] // block_items), -(-2 * size[1] // block_bytes))
    dealt = staged(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "item-blocks")

    def count(batch: pa.RecordBatch) -> dict:
        out: dict = {"i": [], "term": [], "n": []}
        for block, text in zip(batch.column("block").to_pylist(), batch.column("t").to_pylist()):
            terms = terms_of(text.encode())
            for t in {*terms, *([b""] if terms else [])}:  # the empty term stands for the item itself
                out["i"].append(block)
                out["term"].append(t)
                out["n"].append(len(terms) if t == b"" else 1)
        return out

    terms = staged(map_batches(dealt.select("block", "t"), count, _ITEM_TERMS, rows=1000), "item-terms")
    own = terms.filter(F.length("term") == 0).agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    holders = staged(terms.filter(F.length("term") > 0).groupBy("term").agg(F.sum("n").alias("n")), "term-holders")
    for b in range(blocks):
        part = [(r["i"], r["t"]) for r in dealt.filter(F.col("block") == b).collect()]
        if part:
            wanted = terms.filter(F.col("i") == b).select("term").distinct()
            counts = {bytes(r["term"]): r["n"] for r in holders.join(wanted, "term").collect()}
            yield part, Benchmark(own[0], own[1] or 0, own[2] or 0, counts)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, ngram: int = 5,
                    least_overlap: float = 0.6, block_items: int = 20_000, block_bytes: int = 32 << 20,
                    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """One row for each document and test item that it holds, at the best passage.

    (doc_id, item_id, score, question_overlap, answer_overlap, text_key):
    ``score`` is the share of the item's BM25 weight in the passage and at least
    ``threshold``; both overlaps are shares of n-grams and at least
    ``least_overlap``.  Null or empty texts and items match nothing; equal
    items of one id count once; rows repeating a document give a row each; empty tables
    give an empty result.  ``text_key`` is a hash of the document's text.
    Passages are windows of twice the longest item with half a window between their
    starts, so every place where an item can stand lies whole in one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"),
                       docs[text_col].cast("binary").alias("text"))
    spark, found = docs.sparkSession, None
    for block, whole in item_blocks(benchmark, block_items, block_bytes, item_col, item_text_col):
        index = spark.sparkContext.broadcast(ItemIndex(block, whole))

        def search(batch: pa.RecordBatch, index=index) -> dict:
            ix: ItemIndex = index.value
            out: dict = {f.name: [] for f in _LEAKS}
            if not ix.items:
                return out
            for doc, key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(),
                                       batch.column("text")):
                words = terms_of(value.as_py() or b"")
                ids = np.fromiter(map(ix.term_ids.get, words, repeat(-1)), np.int64, len(words))
                best: dict[int, tuple] = {}
                for a, b in ix.passages(ids, threshold):
                    passage = words[a:b]
                    for item, score in ix.retrieve({int(t) for t in ids[a:b] if t >= 0}, threshold):
                        item_id, text, _ = ix.items[item]
                        question, answer = question_and_answer(text)
                        shares = overlap(question, passage, ngram), overlap(answer, passage, ngram)
                        if min(shares) >= least_overlap:
                            best[item_id] = max(best.get(item_id, (0.0,)), (score, *shares))
                for item_id, (score, q, a) in best.items():
                    for name, v in zip(out, (doc, item_id, min(1.0, score), q, a, key)):
                        out[name].append(v)
            return out

        part = map_batches(rows, search, _LEAKS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _LEAKS)
    return found


def without_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose (id, text) holds a test item."""
    marked = sized(staged(leaks.select("doc_id", "text_key").distinct(), "leaks"), 32)
    rows = docs.select(packed(docs), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("key"))
    on = rows["id"].eqNullSafe(marked["doc_id"]) & (rows["key"] == marked["text_key"])
    return rows.join(marked, on, "left_anti").select("row.*")
