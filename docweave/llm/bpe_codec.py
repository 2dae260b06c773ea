"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Leaf i holds (rank of the pair that starts at symbol i, i), or a value above all
others; each inner node holds the smallest of its children, so the root is the
leftmost pair of the lowest rank.  A merge changes at most three leaves, each in
logarithmic time, until the root says that no mergeable pair is left.  A node has
up to 16 children: most pieces then need a root and no other inner node.
"""

from __future__ import annotations

import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.bpe import POSITION_BITS, Unevenly, Vocabulary, broadcast_file, parsed, spaced_units
from docweave.llm.common import TwoGenerations, map_batches

_POSITION = (1 << POSITION_BITS) - 1
_NONE = 1 << 62
_CHILDREN = 16


def merge_piece(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Token ids of one piece; ``symbols`` (ids of its bytes) is used up."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of, merged = vocab.pairs.get, vocab.merged
    leaves = [_NONE] * (n - 1)
    for i in range(n - 1):
        r = rank_of(symbols[i] << 20 | symbols[i + 1])
        if r is not None:
            leaves[i] = r | i
    uppers, top = [], leaves
    while len(top) > _CHILDREN:
        top = [min(top[k:k + _CHILDREN]) for k in range(0, len(top), _CHILDREN)]
        uppers.append(top)

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while True:
        first = min(top)
        if first == _NONE:
            break
        at = first & _POSITION
        right = after[at]
        symbol = symbols[at] = merged[first >> POSITION_BITS]
        symbols[right] = -1
        follower = after[at] = after[right]
        leaves[at] = _NONE
        if follower < n:
            leaves[right] = _NONE
            before[follower] = at
            r = rank_of(symbol << 20 | symbols[follower])
            if r is not None:
                leaves[at] = r | at
        leader = before[at]
        if leader >= 0:
            r = rank_of(symbols[leader] << 20 | symbol)
            leaves[leader] = _NONE if r is None else r | leader
        if uppers:
            for node in (leader, at, right):
                if not 0 <= node < n - 1:
                    continue
                lower = leaves
                for upper in uppers:
                    node //= _CHILDREN
                    least = min(lower[node * _CHILDREN:(node + 1) * _CHILDREN])
                    if upper[node] == least:
                        break
                    upper[node] = least
                    lower = upper
    return [s for s in symbols if s >= 0]


class Codec:
    """Ids of texts as little-endian unsigned 32-bit integers, and texts of ids."""

    def __init__(self, vocab: Vocabulary, memo: int = 500_000):
        self.vocab = vocab
        self.pieces = TwoGenerations(self._piece, memo)
        self.units = TwoGenerations(self._unit, max(1, memo // 8))
        self.spaced = TwoGenerations(self._spaced, max(1, memo * 3 // 8))

    def _piece(self, piece: str) -> bytes:
        found = merge_piece(list(map(self.vocab.byte_ids.__getitem__, piece.encode())), self.vocab)
        return struct.pack(f"<{len(found)}I", *found)

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.vocab.fine.findall(unit)))

    def _spaced(self, unit: str) -> bytes:
        return b"".join(map(self._unit, self.vocab.units_after_space(unit)))

    def _section(self, text: str) -> list[bytes]:
        first, gap, rest = text.partition(" ")
        if gap and first:
            try:
                return [*map(self.units.__getitem__, self.vocab.coarse.findall(first)),
                        *spaced_units(self.spaced, rest)]
            except Unevenly:
                pass
        return list(map(self.units.__getitem__, self.vocab.coarse.findall(text)))

    def encode(self, text: str) -> bytes:
        out = []
        for k, section in enumerate(self.vocab.sections(text)):
            out.extend([struct.pack("<I", self.vocab.added[section])] if k % 2 else self._section(section))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        if struct.pack("=I", 1) != struct.pack("<I", 1):
            ids.byteswap()
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_CODECS: dict[tuple[int, int], Codec] = {}

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType()),
                        T.StructField("round_trip", T.BooleanType())])


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  memo: int = 500_000) -> DataFrame:
    """(doc_id, n_tokens, ids_le, decoded, round_trip) of every row of ``docs``.

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers and
    ``decoded`` the text that those ids give back; ``round_trip`` says that it
    is the text that was encoded.  A null text is encoded as
    the empty text (no ids, decoded empty).  Texts are encoded whole; repeated
    rows give repeated rows; an empty table gives an empty result; other
    columns are not read.  Added tokens inside a text become their own ids.
    ``memo``: pieces that a worker remembers, at about 600 bytes of its memory each.
    """
    data = broadcast_file(docs.sparkSession, tokenizer_path)

    def run(batch: pa.RecordBatch) -> dict:
        vocab = parsed(data.value)
        codec = _CODECS.setdefault((id(vocab), memo), Codec(vocab, memo))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        packed = [codec.encode(t) for t in texts]
        decoded = [codec.decode(p) for p in packed]
        return {"doc_id": batch.column(0), "n_tokens": [len(p) // 4 for p in packed], "ids_le": packed,
                "decoded": decoded, "round_trip": [a == b for a, b in zip(texts, decoded)]}

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col]), run, ENCODED, rows=256)
