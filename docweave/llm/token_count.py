"""Token counts by byte-pair merging on a linked list with a heap of adjacent pairs.

The lowest-ranked adjacent pair is popped, merged and its new neighbours are
pushed, until no mergeable pair is left; the count of a piece is its number of
initial symbols minus its merges.  No token ids leave the operator.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.bpe import POSITION_BITS, Unevenly, Vocabulary, broadcast_file, parsed, spaced_units
from docweave.llm.common import TwoGenerations, map_batches

_POSITION = (1 << POSITION_BITS) - 1


def count_merges(symbols: list[int], vocab: Vocabulary) -> int:
    """Merges that byte-pair encoding makes in one piece; ``symbols`` is used up."""
    rank_of, merged = vocab.pairs.get, vocab.merged
    heap = [r | i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            if (r := rank_of(a << 20 | b)) is not None]
    if not heap:
        return 0
    heapify(heap)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        top = heappop(heap)
        at = top & _POSITION
        right = after[at]
        if right >= n or symbols[at] < 0 or rank_of(symbols[at] << 20 | symbols[right]) != top - at:
            continue  # one of the two has been merged since
        merges += 1
        symbol = symbols[at] = merged[top >> POSITION_BITS]
        symbols[right] = -1
        follower = after[at] = after[right]
        if follower < n:
            before[follower] = at
            r = rank_of(symbol << 20 | symbols[follower])
            if r is not None:
                heappush(heap, r | at)
        leader = before[at]
        if leader >= 0:
            r = rank_of(symbols[leader] << 20 | symbol)
            if r is not None:
                heappush(heap, r | leader)
    return merges


class TokenCounter:
    """Token counts of texts; counts of short units and pieces are memoised, bounded."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pieces = TwoGenerations(self._piece, 500_000)
        self.units = TwoGenerations(self._unit, 100_000)
        self.spaced = TwoGenerations(self._spaced, 200_000)

    def _piece(self, piece: str) -> int:
        data = piece.encode()
        return len(data) - count_merges(list(map(self.vocab.byte_ids.__getitem__, data)), self.vocab)

    def _unit(self, unit: str) -> int:
        return sum(map(self.pieces.__getitem__, self.vocab.fine.findall(unit)))

    def _spaced(self, unit: str) -> int:
        return sum(map(self._unit, self.vocab.units_after_space(unit)))

    def _section(self, text: str) -> int:
        first, gap, rest = text.partition(" ")
        if gap and first:
            try:
                return sum(map(self.units.__getitem__, self.vocab.coarse.findall(first))) + sum(
                    spaced_units(self.spaced, rest))
            except Unevenly:
                pass
        return sum(map(self.units.__getitem__, self.vocab.coarse.findall(text)))

    def count(self, text: str) -> int:
        return sum(1 if k % 2 else self._section(s) for k, s in enumerate(self.vocab.sections(text)))


_COUNTERS: dict[int, TokenCounter] = {}

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens).  Texts are counted whole,
    whatever their length; repeated rows give repeated rows; an empty table
    gives an empty result; other columns are not read.  Added tokens inside a
    text count one each.  ``limit``: ``over_limit`` says n_tokens > limit.
    """
    data = broadcast_file(docs.sparkSession, tokenizer_path)

    def count(batch: pa.RecordBatch) -> dict:
        vocab = parsed(data.value)
        counter = _COUNTERS.setdefault(id(vocab), TokenCounter(vocab))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [counter.count(t) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens]}

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col]), count, SCHEMA, rows=256)
