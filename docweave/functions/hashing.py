"""Feature hashing (Weinberger et al., 2009) as plain Column expressions.

A term goes to bucket ``first 32 bits of md5(term) mod dim``.  md5 is used
instead of a faster hash so the DuckDB oracle can reproduce every bucket.  A
text's vector is kept sparse: its sorted buckets are cut into runs, one index
and one value for each, so the work follows the number of terms and not the
dimension.  The dense form, runs with zeros between them, is made on output only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.arrow import as_lists, coded, lengths
from docweave.functions.vectors import let

# Terms whose bucket a task remembers.
KNOWN_TERMS = 1 << 18


def term_bucket(term: Column, dim: int) -> Column:
    high32 = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")
    return F.pmod(high32, F.lit(dim).cast("bigint"))


def run_starts(ordered: Column) -> Column:
    """ARRAY<INT>: where each run of equal elements begins (from 0) in a sorted array."""
    places = F.transform(ordered, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    starts = F.filter(places, lambda p: (p["i"] == 0) | (p["x"] != F.get(ordered, p["i"] - 1)))
    return F.transform(starts, lambda p: p["i"])


def run_lengths(starts: Column, total: Column) -> Column:
    return F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), total) - s)


def bucket_runs(term_array: Column, dim: int) -> Column:
    """STRUCT<index ARRAY<BIGINT>, value ARRAY<DOUBLE>>: the buckets of the terms in order, and their counts."""
    def runs(buckets: Column) -> Column:
        return let(run_starts(buckets), lambda starts: F.struct(
            F.transform(starts, lambda s: F.get(buckets, s)).alias("index"),
            F.transform(run_lengths(starts, F.size(buckets)), lambda n: n.cast("double")).alias("value")))

    return let(F.sort_array(F.transform(term_array, lambda t: term_bucket(t, dim))), runs)


def sparse_unit(term_array: Column, dim: int) -> Column:
    """STRUCT<index ARRAY<BIGINT>, value ARRAY<FLOAT>>: ``bucket_runs`` at unit length; no entries without terms."""
    def unit(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v["value"], F.lit(0.0), lambda acc, x: acc + x * x))
        return let(length, lambda n: F.struct(
            v["index"].alias("index"),
            F.transform(v["value"], lambda x: F.try_divide(x, n).cast("float")).alias("value")))

    return let(bucket_runs(term_array, dim), unit)


def filled(index: Column, value: Column, size: Column, zero: Column) -> Column:
    """Array of ``size`` elements: the values at their (ascending) index, ``zero`` elsewhere."""
    def spread(v: Column) -> Column:
        def gap(i: Column, k: Column) -> Column:
            return (F.coalesce(F.get(v["at"], k + 1), size) - i - 1).cast("int")

        rest = F.transform(v["at"], lambda i, k: F.concat(F.array(F.get(v["x"], k)), F.array_repeat(zero, gap(i, k))))
        head = F.array_repeat(zero, F.coalesce(F.get(v["at"], F.lit(0)), size).cast("int"))
        return F.concat(head, F.flatten(rest))

    return let(F.struct(index.alias("at"), value.alias("x")), spread)


def dense(sparse: Column, dim: int) -> Column:
    """ARRAY<FLOAT> of length ``dim``: the values at their index, zeros elsewhere."""
    return let(sparse, lambda v: F.when(v.isNotNull(), filled(
        v["index"], v["value"], F.lit(dim).cast("bigint"), F.lit(0.0).cast("float"))))


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two sparse vectors: their entries in one order, equal neighbours multiplied."""
    def entries(v: Column) -> Column:
        return F.arrays_zip(v["index"].alias("i"), v["value"].alias("x"))

    def total(merged: Column) -> Column:
        products = F.transform(merged, lambda e, k: F.when(
            F.get(merged, k + 1)["i"] == e["i"], e["x"].cast("double") * F.get(merged, k + 1)["x"].cast("double")))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0)))

    return let(F.sort_array(F.concat(entries(a), entries(b))), total)


def hashed_vector(term_array: Column, dim: int) -> Column:
    """Unit-length hashed term-count vector, ARRAY<FLOAT> of length ``dim``; zero without terms."""
    return dense(sparse_unit(term_array, dim), dim)


class TermCodes(dict):
    """Code of each term met, with its bucket in ``table``; begun anew where a piece starts with too many."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim, self.new, self.table = dim, [], np.zeros(0, np.int64)

    def __missing__(self, term: str) -> int:
        self.new.append(int.from_bytes(hashlib.md5(term.encode("utf-8")).digest()[:4], "big") % self.dim)
        self[term] = code = len(self)
        return code

    def of_piece(self, terms: Iterable[str], n: int) -> np.ndarray:
        """Codes of the ``n`` terms of a piece; those of other pieces may not be compared with them."""
        if len(self) > KNOWN_TERMS:
            self.clear()
            self.table = np.zeros(0, np.int64)
        found = np.fromiter(map(self.__getitem__, terms), np.int64, n)
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.int64)])
            self.new.clear()
        return found


def unit_lists(at: np.ndarray, sizes: np.ndarray, texts: np.ndarray, dim: int) -> pa.Array:
    """``hashed_vector`` of texts with ``sizes`` terms in the buckets ``at``, as lists of as many as ``texts`` says."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    count = np.bincount(row * dim + at, minlength=len(sizes) * dim).reshape(len(sizes), dim).astype(np.float64)
    length = np.sqrt((count * count).sum(axis=1, keepdims=True))
    unit = (count / np.where(length > 0, length, 1.0)).astype(np.float32)
    return as_lists(as_lists(pa.array(unit.reshape(-1)), np.full(len(sizes), dim)), texts)


def hashed_lists(dim: int):
    """``hashed_vector`` of every text of lists of texts, on Arrow: LIST<LIST<STRING>> to LIST<LIST<FLOAT>>."""
    class Buckets(dict):
        def __missing__(self, term: str) -> int:
            found = int.from_bytes(hashlib.md5(term.encode("utf-8")).digest()[:4], "big") % dim
            if len(self) < KNOWN_TERMS:
                self[term] = found
            return found

    bucket = Buckets().__getitem__

    def vectors(lists: pa.Array) -> pa.Array:
        texts = lists.flatten()
        codes, values = coded(texts.flatten())
        at = np.fromiter(map(bucket, values), np.int64, len(values))[codes]
        return unit_lists(at, lengths(texts), lengths(lists), dim)

    return vectors
