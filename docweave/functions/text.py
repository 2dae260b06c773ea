"""Column-level text functions (JVM-side expressions, no Python UDFs).

Java's ``\\s``/``\\w`` are ASCII-only and differ from RE2's on a few control
characters, so every class below is written out explicitly.  The same
patterns run unchanged in DuckDB (RE2), which is what the SQL oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a whitespace trim: exactly those Python's str.isspace()
# accepts (a rule, evaluated over the whole code-point range).
WHITESPACE_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def _char_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


# Line boundaries of str.splitlines(): \r\n, \n, \r, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Whitespace runs, for str.split() with no separator.
WHITESPACE_RUN = "[" + _char_class(WHITESPACE_CHARS) + "]+"

# Approximate byte-pair token: a letter run, up to three digits, or a run of
# other non-blank characters.  Counts tokens without a vocabulary.
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\t\n\x{b}\f\r \p{L}\p{N}]+"

# Vocabulary term: two or more letters, digits or underscores, lower-cased text.
TERM = r"[\p{L}\p{N}_]{2,}"
TERM_LETTERS = 2


def strip_ws(col: Column) -> Column:
    """Unicode-aware trim (str.strip() semantics)."""
    return F.btrim(col, F.lit(WHITESPACE_CHARS))


def clean_lines(text: Column) -> Column:
    """Split on line boundaries, trim each line, drop blank ones -> ARRAY<STRING>."""
    lines = F.transform(F.split(text, LINE_BREAK), strip_ws)
    return F.filter(lines, lambda x: x != F.lit(""))


def token_count(text: Column) -> Column:
    """Approximate token count of a string (BIGINT); 0 for an empty string."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def terms(text: Column) -> Column:
    """Lower-cased vocabulary terms of a string, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def spaced_terms(text: Column) -> Column:
    """``terms`` and shorter runs of a string in one string, apart by spaces: ``TERM_LETTERS`` tells them apart."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def words(text: Column) -> Column:
    """Raw whitespace-separated words (str.split() semantics), case kept.

    Every whitespace character is first mapped to a space (a native
    character translation), so the split is on one character only.
    """
    spaced = F.translate(text, WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    return F.filter(F.split(spaced, " "), lambda x: x != F.lit(""))
