"""Main text of web pages (F3, F4), row by row in JVM expressions.

Side elements (navigation, headers, forms, blocks of an advertising class, ...) go
with everything nested in them, block-level tags become line breaks, lists of
links go by the share of their characters that are links, and character
references are decoded (``&amp;`` last).  This is a deterministic
approximation of a readability extractor, not a copy of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.markup import (
    element_spans, html_tokens, inside, is_side, outside, plain_text, without_link_lists,
)
from docweave.functions.text import strip_ws
from docweave.functions.vectors import let
from docweave.operators.fragments import split_fragments

# Classes of block elements that hold no content of the page.
SIDE_CLASSES = ("ad",)

# Numeric character references, decimal (group 1) or hexadecimal (group 2).
NUMERIC = r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));"

# Entities, replaced literally in this order ("&amp;" last, so nothing is decoded twice).
ENTITIES = [("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"),
            ("&nbsp;", "\u00a0"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"),
            ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
            ("&euro;", "€"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]

def _character(reference: Column) -> Column:
    """The character of a numeric reference; the reference itself if there is none of that number."""
    decimal = F.nullif(F.regexp_extract(reference, NUMERIC, 1), F.lit(""))
    hexadecimal = F.nullif(F.regexp_extract(reference, NUMERIC, 2), F.lit(""))
    code = F.coalesce(decimal.cast("int"), F.conv(hexadecimal, 16, 10).cast("int"))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(reference)


def decode_numeric(text: Column) -> Column:
    """Numeric character references replaced; each distinct one of a text is looked up once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC), 0))
    return F.when(F.contains(text, F.lit("&#")), F.aggregate(
        found, text, lambda acc, r: F.replace(acc, r, _character(r)))).otherwise(text)


def _text(tokens: Column, side_classes: tuple[str, ...]) -> Column:
    content = let(tokens, lambda t: outside(t, element_spans(t, lambda tag: is_side(tag, side_classes))))
    out = decode_numeric(without_link_lists(plain_text(content)))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_text(html: Column, side_classes: tuple[str, ...] = SIDE_CLASSES) -> Column:
    """Text of a page without its side blocks; ``side_classes`` are classes of blocks to leave out."""
    return _text(html_tokens(html), side_classes)


def _articles(html: Column) -> Column:
    return let(html_tokens(html), lambda t: inside(t, element_spans(t, lambda tag: tag.rlike(r"(?i)^<article\b"))))


def article_html(html: Column) -> Column:
    """The content of every outermost article element, one after another; empty without one."""
    return F.array_join(F.transform(_articles(html), lambda t: F.array_join(t, "")), "\n")


def text_or_fallback(primary: Column, fallback: Column) -> Column:
    """F4. The primary extraction unless it is blank, else the fallback."""
    return F.coalesce(F.nullif(strip_ws(primary), F.lit("")), fallback)


def html_fragments(pages: DataFrame, name_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """F3. (name, pos, text) fragments of each page's main text; a null page has none."""
    return split_fragments(pages.select(F.col(name_col).alias("name"),
                                        html_text(F.col(html_col)).alias("text")))


def page_text_with_fallback(pages: DataFrame, name_col: str = "page_id",
                            html_col: str = "html") -> DataFrame:
    """F4 over pages: the text of the article elements, or the whole page's when that is blank."""
    articles = F.flatten(F.transform(_articles(F.col(html_col)), lambda t: F.concat(t, F.array(F.lit("<br>")))))
    return pages.select(F.col(name_col).alias("name"),
                        text_or_fallback(_text(articles, SIDE_CLASSES), html_text(F.col(html_col))).alias("text"))
