"""Token counts and the codec against the tokenizers library."""

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import queries
from docweave.llm.bpe import Vocabulary, parsed
from docweave.llm.bpe_codec import Codec, encode_decode
from docweave.llm.common import TwoGenerations
from docweave.llm.token_count import TokenCounter, token_counts

PATH = public_tokenizers.path(queries.BYTE_BPE)
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    VOCAB = parsed(f.read())
COUNTER, CODEC = TokenCounter(VOCAB), Codec(VOCAB)
PARTS = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'re", "é", "中", "1", "½", "<|endoftext|>",
                         "<|end", "😀", "　", "\xa0", "\x1c", "!", "_", "Zq", "\r\n"])


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=40).map("".join), st.text(max_size=40)))
def test_same_as_the_library(text):
    ids = ids_of(text)
    packed = CODEC.encode(text)
    assert COUNTER.count(text) == len(ids)
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert CODEC.decode(packed) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_operators_on_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    expected = sorted(((i, len((t or "").encode()), len(ids_of(t or ""))) for i, t, *_ in odd_rows), key=repr)
    counts = token_counts(docs, PATH).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counts), key=repr) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in counts)
    coded = encode_decode(docs, PATH).collect()
    assert sorted(((r.doc_id, len(r.decoded.encode()), r.n_tokens) for r in coded), key=repr) == expected
    assert all(r.round_trip for r in coded)
    assert token_counts(docs.limit(0), PATH).count() == encode_decode(docs.limit(0), PATH).count() == 0


def test_codec_query_hashes(spark):
    from conftest import SMOKE
    found = {r.doc_id: r for r in queries.op9_bpe_codec(spark, SMOKE).collect()}
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = ids_of(d.text or "")
        assert found[d.doc_id].n_tokens == len(ids)
        assert found[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_other_files_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        Vocabulary(f.read())


def test_memo_is_bounded_and_right():
    memo = TwoGenerations(len, size=3)
    for k in ["a", "bb", "ccc", "dddd", "a", "eeeee", "bb", "x" * 100, "a"]:
        assert memo[k] == len(k)
        assert len(memo) <= 3 and len(memo.older) <= 3


@pytest.mark.parametrize("size", [1, 2, 16, 17, 18, 40, 257, 300, 4200])
def test_pieces_of_every_tree_height(size):
    """Against merging the first pair of the lowest rank again and again; no call of Python's for each merge."""
    import random
    import sys

    from docweave.llm.bpe_codec import merge_piece

    with open(PATH, "rb") as f:
        vocab = Vocabulary(f.read())
    rnd = random.Random(size)
    for letters in ("etaoinshrdlu", "ab", "-="):
        piece = [vocab.byte_ids[ord(rnd.choice(letters))] for _ in range(size)]
        want = list(piece)
        while True:
            ranked = [(vocab.pairs[a << 20 | b], i) for i, (a, b) in enumerate(zip(want, want[1:]))
                      if a << 20 | b in vocab.pairs]
            if not ranked:
                break
            rank, i = min(ranked)
            want[i:i + 2] = [vocab.merged[rank >> 40]]
        calls = []
        sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
        try:
            got = merge_piece(list(piece), vocab)
        finally:
            sys.setprofile(None)
        assert got == want
        assert [c for c in calls if c != "<listcomp>"] == (["merge_piece"])
