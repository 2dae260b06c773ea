"""Document identity (F6) and document URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import clean_lines


def content_id_of(fragments: Column) -> Column:
    """128-bit hex fingerprint of an ARRAY<STRING> of fragments joined by newline."""
    return F.md5(F.array_join(fragments, "\n"))


def content_id_of_text(text: Column) -> Column:
    """Fingerprint of raw text after fragmenting (row-wise, no shuffle)."""
    return content_id_of(clean_lines(text))


def content_id(fragments: DataFrame) -> DataFrame:
    """F6 over a fragments table (name, pos, text) -> (name, content_id).

    Fragments of one name come from one source row, so the rebuilt list is no
    larger than that row.  Prefer ``content_id_of_text`` when the source row
    is at hand.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return fragments.groupBy("name").agg(content_id_of(ordered).alias("content_id"))


def make_uri(content: Column, lang: Column) -> Column:
    return F.concat_ws("/", content, lang)


def parse_uri(uri: Column) -> tuple[Column, Column]:
    return (F.split_part(uri, F.lit("/"), F.lit(1)), F.split_part(uri, F.lit("/"), F.lit(2)))
