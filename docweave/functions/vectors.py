"""Dense-vector Column functions over ARRAY<FLOAT|DOUBLE>.

All arithmetic is done in double precision.  Division uses try_divide so a
zero norm or zero maximum yields NULL instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable).

    Catalyst does not share sub-expressions inside higher-order functions: an
    outer expression used in a lambda body is recomputed for every element.
    Binding it through a one-element ``transform`` evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, array: Column, at: str, element: str, *keep: Column | str) -> DataFrame:
    """(*keep, at, element): a row for each element of a computed array, none for an empty or null one.

    A plain ``posexplode`` makes the optimizer filter on the array's size below
    it, which computes the array twice (and inside other lambdas, many times);
    the outer form does not, so its one row for an empty array is dropped after it.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, element))
    return rows.filter(F.col(at).isNotNull())


def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; NULL if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, p: acc + p)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0).cast("double"),
                          lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(a: Column, b: Column, norm_a: Column | None = None,
           norm_b: Column | None = None) -> Column:
    """Cosine similarity; NULL when either vector has zero length."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return F.try_divide(dot(a, b), na * nb)


def scale(a: Column, k: Column) -> Column:
    return let(k, lambda kk: F.transform(a, lambda x: x.cast("double") * kk))


def vmax(a: Column) -> Column:
    return F.array_max(a).cast("double")


def normalize(a: Column) -> Column:
    """Unit-length copy (FLOAT elements); a zero vector stays zero."""
    def unit(v: Column) -> Column:
        return let(norm(v), lambda n: F.transform(
            v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)).cast("float")))

    return let(a, unit)
