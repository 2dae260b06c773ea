"""Fragmenting, labelling and ordering of document text.

A document arrives as one row, so splitting it into numbered fragments is a
row-wise ``posexplode``: no shuffle, and no group can outgrow its source row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.constants import SENTENCE_CLOSERS
from docweave.functions.text import clean_lines, strip_ws
from docweave.functions.vectors import exploded
from docweave.plans.scan import dense_positions, running_total


def split_fragments(docs: DataFrame, text_col: str = "text", name_col: str = "name",
                    keep: tuple[str, ...] = (), with_count: bool = False) -> DataFrame:
    """F1. One row per non-blank trimmed line: (name, *keep, pos, text), pos from 0.

    ``with_count`` adds ``n_fragments`` (fragments of the document), known
    row-wise at split time, so per-document statistics need no aggregation.
    """
    name, lines = F.col(name_col).alias("name"), clean_lines(F.col(text_col))
    if not with_count:
        return exploded(docs, lines, "pos", "text", name, *keep).withColumn("pos", F.col("pos").cast("bigint"))
    split = docs.select(name, *keep, lines.alias("_lines"))
    return exploded(split, F.col("_lines"), "pos", "text", "name", *keep,
                    F.size("_lines").cast("bigint").alias("n_fragments")).withColumn(
        "pos", F.col("pos").cast("bigint"))


def fragment_arrays(docs: DataFrame, text_col: str = "text", name_col: str = "name",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-document form of F1: (name, *keep, fragments ARRAY<STRING>)."""
    return docs.select(F.col(name_col).alias("name"), *keep,
                       clean_lines(F.col(text_col)).alias("fragments"))


def ends_sentence(text: Column) -> Column:
    return F.substring(text, -1, 1).isin(SENTENCE_CLOSERS)


def reflow_lines(lines: DataFrame, doc_positions: bool = True) -> DataFrame:
    """F2. Glue extracted lines of a page until one ends a sentence; flush at page end.

    Input (name, page, pos, text).  Lines are trimmed and blank ones dropped,
    then concatenated with no separator.  Output (name, page, pos, text) where
    ``pos`` numbers the sentences of the whole document from 0 (or of the page
    when ``doc_positions`` is False).  Input ``pos`` numbers lines within a
    page.  The sentence id is the running count of sentence ends on earlier
    lines of the page, taken in chunks, so a page may be of any size; a
    sentence's lines are glued chunk by chunk and its pieces stitched where it
    crosses a border.  Document numbering runs over the small per-page counts.
    """
    clean = (lines.select("name", "page", "pos", strip_ws(F.col("text")).alias("text"))
             .filter(F.col("text") != ""))
    ends = ends_sentence(F.col("text")).cast("bigint")
    flagged = running_total(clean, ["name", "page"], "pos", ends, "sentence", keep_chunk=True)

    def glued(order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))),
                                        lambda x: x["text"]), "").alias("text")

    pieces = flagged.groupBy("name", "page", "sentence", "_chunk").agg(glued("pos"))
    sentences = pieces.groupBy("name", "page", "sentence").agg(glued("_chunk"))
    if not doc_positions:
        return sentences.withColumnRenamed("sentence", "pos")
    per_page = sentences.groupBy("name", "page").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("name").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_page.select("name", "page",
                              F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (sentences.join(offsets, ["name", "page"])
            .select("name", "page", (F.col("_off") + F.col("sentence")).cast("bigint").alias("pos"),
                    "text"))


def paragraph_fragments(paragraphs: DataFrame) -> DataFrame:
    """F5. Already separated paragraphs (name, pos, text): trim, drop blanks, renumber from 0."""
    clean = (paragraphs.withColumn("text", strip_ws(F.col("text")))
             .filter(F.col("text") != "")
             .withColumnRenamed("pos", "_src_pos"))
    return dense_positions(clean, "name", "_src_pos").select("name", "pos", "text")


def rejected_documents(docs: DataFrame, fragments: DataFrame | None = None,
                       text_col: str = "text", name_col: str = "name") -> DataFrame:
    """F8. Documents that yield no fragment, those without a text included.

    Without ``fragments`` the test is row-wise on the text (no shuffle);
    with a fragments table it is a left-anti join on ``name``.
    """
    if fragments is None:
        return docs.filter(F.col(text_col).isNull() | (F.size(clean_lines(F.col(text_col))) == 0))
    names = fragments.select(F.col("name").alias(name_col)).distinct()
    return docs.join(names, name_col, "left_anti")


def label_paragraph(pos: Column, text: Column) -> Column:
    return F.format_string("paragraph %d: %s", pos, text)


def label_paragraphs(df: DataFrame, out: str = "label") -> DataFrame:
    """F9. "paragraph {pos}: {text}"."""
    return df.withColumn(out, label_paragraph(F.col("pos"), F.col("text")))


def numbered_list(df: DataFrame, key: str, rank: str = "rank", text: str = "label",
                  out: str = "numbered") -> DataFrame:
    """F10. Rows of each ``key`` in ``rank`` order to "0. a\\n1. b..." (numbered from 0).

    Meant for ranked, already limited rows (top-k, budget cut), so a group
    holds at most the retrieval limit.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    joined = F.array_join(
        F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x["t"])), "\n")
    return df.groupBy(key).agg(joined.alias(out), F.count(F.lit(1)).cast("bigint").alias("n_items"))


def numbered_document(docs: DataFrame, fragments_col: str = "fragments", out: str = "numbered") -> DataFrame:
    """F10 of whole documents (name, fragments): the numbered list of all labels, on the document's row."""
    lines = F.transform(fragments_col, lambda x, i: F.concat(
        i.cast("string"), F.lit(". "), label_paragraph(i, x)))
    return docs.filter(F.size(fragments_col) > 0).select(
        "name", F.array_join(lines, "\n").alias(out), F.size(fragments_col).cast("bigint").alias("n_items"))


def preview(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """F11. First ``n`` rows per group (partial top-k before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
