"""HTML as an array of tokens: nesting by a stack, blocks by their link density (JVM expressions only).

A page is cut into tags, comments, raw elements (script and the like, whole) and
text.  Only tags of elements that hold blocks move the stack of open elements,
so the fold over a page is short and nothing in it grows but the list of
spans found.  An end tag closes the innermost open element of its name and all
that was opened inside; one without such an element is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import strip_ws
from docweave.functions.vectors import let

# Elements whose content is not markup, read as one token up to their end tag.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg")
# Elements that hold no content of the page.
SIDE = ("nav", "header", "footer", "aside", "form", "head")
# Other elements whose tags move the stack; those with optional end tags and inline ones do not.
HOLDERS = ("main", "article", "section", "div", "ul", "ol", "dl", "table", "figure", "details", "blockquote")

TOKEN = "|".join([r"(?s:<!--.*?-->)", *[rf"(?is:<{name}\b[^>]*>.*?</{name}\s*>)" for name in RAW],
                  r"""<[/!?A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", r"<[/!?A-Za-z][^>]*>", r"[^<]+", r"<"])
_MOVES = rf"(?i)^</?(?:{'|'.join(SIDE + HOLDERS)})\b"
_NAME = r"^</?([A-Za-z][A-Za-z0-9]*)"

# Marks of where a link begins and ends, in text without markup.
LINK, LINK_END = "\x01", "\x02"
_BREAKS = r"(?i)^</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|main|blockquote|figure|br|hr)\b"


def html_tokens(html: Column) -> Column:
    """Tags, comments, raw elements and texts of a page, in order; nothing is left out."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def of_class(classes: tuple[str, ...]) -> str:
    """Pattern of a start tag with a class that begins with one of ``classes`` as a word."""
    return rf"""(?i)^<[a-z][a-z0-9]*\b.*\sclass\s*=\s*(?:["'](?:[^"'>]*\s)?)?(?:{'|'.join(classes)})\b"""


def is_side(tag: Column, classes: tuple[str, ...] = ()) -> Column:
    """Whether a start tag opens an element without content of the page, by its name or its class."""
    side = tag.rlike(rf"(?i)^<(?:{'|'.join(SIDE)})\b")
    return side | tag.rlike(of_class(classes)) if classes else side


def element_spans(tokens: Column, starts) -> Column:
    """ARRAY<INT> b0, b1, ...: the outermost elements whose start tag ``starts`` accepts are tokens [b0, b1), [b2, b3) ...

    An element that nothing closes but the end of the page counts as not
    there, so that a forgotten end tag does not take the rest of the page.
    """
    moves = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("tag"))),
                     lambda m: m["tag"].rlike(_MOVES))
    moves = F.transform(moves, lambda m: F.struct(
        m["at"].alias("at"), F.lower(F.regexp_extract(m["tag"], _NAME, 1)).alias("name"),
        m["tag"].startswith("</").alias("ends"), starts(m["tag"]).alias("opens")))
    none = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("inside"),
                    F.array().cast("array<int>").alias("spans"))

    def step(state: Column, m: Column) -> Column:
        stack, inside, spans = state["stack"], state["inside"], state["spans"]

        def opened() -> Column:
            new = (inside == 0) & m["opens"]
            return F.struct(F.concat(stack, F.array(m["name"])).alias("stack"),
                            F.when(new, F.size(stack) + 1).otherwise(inside).alias("inside"),
                            F.when(new, F.concat(spans, F.array(m["at"]))).otherwise(spans).alias("spans"))

        def closed(place: Column) -> Column:
            out = (inside > 0) & (place <= inside)
            end = m["at"] + F.when(place == inside, 1).otherwise(0)
            return F.struct(F.slice(stack, F.lit(1), place - 1).alias("stack"),
                            F.when(out, 0).otherwise(inside).alias("inside"),
                            F.when(out, F.concat(spans, F.array(end))).otherwise(spans).alias("spans"))

        behind = F.array_position(F.reverse(stack), m["name"]).cast("int")
        return F.when(~m["ends"], opened()).when(behind == 0, state).otherwise(
            let(F.size(stack) - behind + 1, closed))

    found = F.aggregate(moves, none, step, lambda state: state["spans"])
    return let(found, lambda s: F.slice(s, F.lit(1), F.size(s) - F.size(s) % 2))


def _between(tokens: Column, bounds: Column) -> Column:
    """Tokens [b0, b1), [b2, b3), ... as one array of arrays."""
    pairs = F.filter(F.transform(bounds, lambda b, i: F.struct(b.alias("low"), i.alias("i"))), lambda p: p["i"] % 2 == 0)
    return F.transform(pairs, lambda p: F.slice(tokens, p["low"] + 1, bounds[p["i"] + 1] - p["low"]))


def outside(tokens: Column, spans: Column) -> Column:
    """Tokens that no span holds."""
    bounds = F.concat(F.array(F.lit(0)), spans, F.array(F.size(tokens)))
    return let(bounds, lambda b: F.flatten(_between(tokens, b)))


def inside(tokens: Column, spans: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: the tokens of each span without the element's own tags."""
    def inner(span: Column) -> Column:
        ended = F.element_at(span, -1).startswith("</")
        return F.slice(span, F.lit(2), F.size(span) - F.when(ended, 2).otherwise(1))

    return F.transform(let(spans, lambda b: _between(tokens, b)), inner)


def plain_text(tokens: Column) -> Column:
    """Text of tokens with line breaks for block tags, marks around links, and character references as they stand."""
    def one(t: Column) -> Column:
        return (F.when(~t.startswith("<") | (t == "<"), F.translate(t, LINK + LINK_END, ""))
                .when(t.rlike(rf"(?i)^<(?:!--|(?:{'|'.join(RAW)})\b)"), F.lit(" "))
                .when(t.rlike(_BREAKS), F.lit("\n"))
                .when(t.rlike(r"(?i)^<a\b"), F.lit(LINK)).when(t.rlike(r"(?i)^</a\b"), F.lit(LINK_END))
                .otherwise(F.lit("")))
    return F.array_join(F.transform(tokens, one), "")


def without_link_lists(text: Column) -> Column:
    """Marked text without its lists of links, and without the marks.

    A block is a line.  One of which more than half the characters are in links
    counts as links; two or more of these next to each other (but for blank
    lines) are a list and go.  A single one stays: it may belong to the text.
    """
    def bare(line: Column) -> Column:
        return F.translate(line, LINK + LINK_END, "")

    def scored(line: Column) -> Column:
        rest = F.regexp_replace(line, f"{LINK}[^{LINK_END}]*{LINK_END}?", "")
        whole = strip_ws(bare(line))
        return F.struct(whole.alias("text"),
                        (F.char_length(strip_ws(bare(rest))) * 2 < F.char_length(whole)).alias("links"))

    def cleaned(marked: Column) -> Column:
        blocks = F.filter(F.transform(F.split(marked, "\n"), scored), lambda b: b["text"] != "")

        def listed(b: Column, i: Column, all_: Column) -> Column:
            beside = F.coalesce(F.get(all_, i - 1)["links"], F.lit(False)) | F.coalesce(
                F.get(all_, i + 1)["links"], F.lit(False))
            return b["links"] & beside

        kept = let(blocks, lambda all_: F.filter(all_, lambda b, i: ~listed(b, i, all_)))
        return F.array_join(F.transform(kept, lambda b: b["text"]), "\n")

    return let(text, lambda t: F.when(F.contains(t, F.lit(LINK)), cleaned(t)).otherwise(bare(t)))
