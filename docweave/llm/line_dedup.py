"""Boilerplate lines by their frequency on a site.

For every host, the pages that hold a line are divided by all pages of the
host; lines above a ratio are dropped from that host's pages.  Lines are
compared without blanks at their ends; blank lines are never dropped.

Only DataFrame functions are used.  Counting shuffles two hashes of a line, not
its text; the text of a page never moves unless the dropped lines are too many
to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import join_small, packed, staged

BLANKS = " \t\r\f\x0b"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)), F.lit(""))


# Applied in order to a page; also used by the SQL twin.
PAGE_LINES = [
    (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "),
    (r"(?i)<(/?(p|div|h[1-6]|li|ul|ol|tr|table|nav|header|footer|article|section|title|body)|br)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
]


def page_lines(html: Column) -> Column:
    """Text of a page with one line for each block element, navigation and footers included."""
    for pattern, replacement in PAGE_LINES:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(replacement))
    return html


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def boilerplate_lines(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int,
                      min_hits: int, copies_once: bool = False, small_ratio: float | None = None) -> DataFrame:
    """(host, drop): hashes of the lines on more than ``ratio`` of the host's pages, and on ``min_hits`` at least.

    For hosts of fewer than ``min_pages`` pages the ratio is ``small_ratio``, or
    without one they have no such lines.  With ``copies_once`` pages of one host and the same lines are one page.
    A host's array holds at most (its mean number of lines) / (its ratio) entries.
    """
    base = pages.select(pages[host_col].alias("host"), pages[text_col].alias("text")).filter(F.col("host").isNotNull())
    n = F.count(F.lit(1))
    if copies_once:
        # Hashes alone are made distinct; they combine before the shuffle, so a large group of copies stays cheap.
        base = base.withColumn("page", _key(F.array_remove(_trimmed(F.col("text")), "")))
        n = F.count_distinct("page")
    page = ["page"] if copies_once else []
    totals = base.groupBy("host").agg(n.alias("n_pages")).filter(
        F.col("n_pages") >= (min_pages if small_ratio is None else min_hits))
    limit = F.when(F.col("n_pages") >= min_pages, F.lit(ratio)).otherwise(F.lit(small_ratio)) * F.col("n_pages")
    lines = base.select("host", *page,
                        F.explode(F.array_remove(F.array_distinct(_trimmed(F.col("text"))), "")).alias("line"))
    counts = (lines.select("host", *page, _key(F.col("line")).alias("k")).groupBy("host", "k")
              .agg(n.alias("n")).filter(F.col("n") >= min_hits))
    return (counts.join(totals, "host").filter(F.col("n") > limit)
            .groupBy("host").agg(F.collect_list("k").alias("drop")))


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str = "text", ratio: float = 0.1,
                     min_pages: int = 20, min_hits: int = 5, copies_once: bool = False,
                     small_ratio: float | None = None) -> DataFrame:
    """``pages`` with their boilerplate lines cut out of the text, and ``n_lines``, ``n_dropped``.

    Every input column is kept (two more are added; input columns of those
    names are replaced).  A line counts once per page however often it stands
    there.  Every repeated row counts as a page, or with ``copies_once`` only
    the first of the rows of a host that have the same lines, so that copies of
    a text do not make its lines boilerplate.  A line goes if it stands on more
    than ``ratio`` of its host's pages; on hosts with fewer than ``min_pages``
    pages the ratio is ``small_ratio``, and without one they keep all lines.
    Null hosts keep all lines, and so do lines on fewer than ``min_hits`` pages.  A null text stays null
    with no lines; an empty table gives an empty result.  ``n_lines`` counts
    the lines that are not blank.
    """
    flagged = staged(boilerplate_lines(pages, host_col, text_col, ratio, min_pages, min_hits, copies_once, small_ratio),
                     "site-lines")
    entries = flagged.agg(F.max(F.size("drop"))).first()[0] or 0
    rows = pages.select(packed(pages), pages[host_col].alias("host"), pages[text_col].alias("text"))
    joined = join_small(rows, flagged, ["host"], 64 + 24 * entries, F.xxhash64("text"))

    def kept(line: Column) -> Column:
        return ~F.array_contains(F.col("drop"), _key(F.btrim(line, F.lit(BLANKS))))

    clean = F.when(F.col("drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), kept), "\n"))
    cut = joined.select("row", "text", clean.alias("clean"))
    full = F.size(F.array_remove(_trimmed(F.col("text")), ""))
    made = {text_col: F.col("clean"), "n_lines": full.cast("long"),
            "n_dropped": (full - F.size(F.array_remove(_trimmed(F.col("clean")), ""))).cast("long")}
    names = [*pages.columns, *[c for c in made if c not in pages.columns]]
    return cut.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in names])
