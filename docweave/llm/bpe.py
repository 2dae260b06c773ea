"""Byte-level BPE files: pieces of a text, byte symbols and merge ranks.

Reads a ``tokenizers`` JSON file whose pre-tokenizer is ByteLevel with its
regular expression and without a prefix space, whose model is BPE and which has
no normalizer; any other file is refused.  The file is read once on the driver
and broadcast as bytes; workers parse it once each.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata

from pyspark.sql import SparkSession

# Positions in a piece; a pair in a heap or tree is rank << POSITION_BITS | position.
POSITION_BITS = 40

# White space of the Unicode property list, fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"


_SPACE_CHARS = [chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c))]


def _ranges(major: str) -> str:
    """Character class body of all code points whose category starts with ``major``."""
    out, start, last = [], None, None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == major
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        last = code
    return "".join(out)


def pieces_pattern() -> tuple[re.Pattern, re.Pattern]:
    """(coarse, fine): blank-separated units of a text, and the pieces inside one unit.

    A unit is a run of non-blanks with at most one leading space, or a run of
    blanks.  The pieces of a unit do not depend on its neighbours, so units can be memoised.
    """
    letter, number = _ranges("L"), _ranges("N")
    other = f"[^{_SPACE}{letter}{number}]"
    coarse = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
    fine = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?{other}+|[{_SPACE}]+")
    return coarse, fine


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + extra)
            extra += 1
    return [chars[b] for b in range(256)]


class Unevenly(Exception):
    """A text whose blanks are not all single spaces between units."""


def spaced_units(memo: dict, text: str) -> list:
    """What ``memo`` holds for each unit of a text whose units are all split by one space.

    The memo's key is the unit without its leading space; its maker raises
    ``Unevenly`` for an empty unit or one that starts with a blank (a blank at its end
    takes the same piece with or without the space that follows).
    """
    return list(map(memo.__getitem__, text.split(" ")))


class Vocabulary:
    """Ids of single bytes, ranks and results of pairs, byte strings of ids, added tokens."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges")):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        vocab = model["vocab"]
        chars = byte_chars()
        of_char = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        self.pairs: dict[int, int] = {}   # left id << 20 | right id -> rank << POSITION_BITS
        self.merged: list[int] = []       # rank -> id of the merged symbol
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] << 20 | vocab[right]] = rank << POSITION_BITS
            self.merged.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_char[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.coarse, self.fine = pieces_pattern()
        self.is_blank = frozenset(_SPACE_CHARS)

    def units_after_space(self, unit: str) -> list[str]:
        """The units of a space followed by ``unit``, if no neighbour can change them."""
        if not unit or unit[0] in self.is_blank:
            raise Unevenly
        return self.coarse.findall(" " + unit)

    def sections(self, text: str) -> list[str]:
        """The text cut at added tokens; every odd entry is an added token."""
        return self.added_pattern.split(text) if self.added_pattern else [text]


_PARSED: dict[str, Vocabulary] = {}


def parsed(data: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, parsed once in each process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _PARSED:
        _PARSED[key] = Vocabulary(data)
    return _PARSED[key]


def broadcast_file(spark: SparkSession, path: str):
    """The vocabulary file (a few MB, a fixed size) as a broadcast variable."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
