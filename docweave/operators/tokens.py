"""Token counting, batch packing, budget cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.constants import RESERVE_TOKENS
from docweave.functions.text import token_count
from docweave.functions.vectors import exploded, let
from docweave.operators.packing import pack_large
from docweave.plans.scan import running_total
from docweave.plans.sizing import NAME_BYTES, materialize, maybe_broadcast


def _batch_ends(tokens: Column, limit: int) -> Column:
    """Positions closing a batch: a batch closes after the fragment that pushes
    its running total above ``limit`` (inclusive), and the total restarts at 0.

    Only closing positions are appended to the fold state, so the fold is
    linear in fragments (plus the number of batches).
    """
    init = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("run"),
                    F.array().cast("array<bigint>").alias("ends"))

    def step(acc, t):
        run = acc["run"] + t
        return F.when(run > F.lit(limit), F.struct(
            (acc["i"] + 1).alias("i"), F.lit(0).cast("bigint").alias("run"),
            F.array_append(acc["ends"], acc["i"]).alias("ends"),
        )).otherwise(F.struct((acc["i"] + 1).alias("i"), run.alias("run"), acc["ends"].alias("ends")))

    return F.aggregate(tokens, init, step)["ends"]


def batch_ids(ends: Column, n: Column) -> Column:
    """Batch of each of ``n`` fragments: batch k runs up to the k-th end, the last one to the end."""
    def of_batch(k: Column) -> Column:
        upto = F.coalesce(F.get(ends, k), n.cast("bigint") - 1)
        before = F.coalesce(F.get(ends, k - F.lit(1)), F.lit(-1).cast("bigint"))
        return F.array_repeat(k.cast("bigint"), (upto - before).cast("int"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends)), of_batch))


def pack_document_batches(docs: DataFrame, max_tokens: int, reserve: int = RESERVE_TOKENS,
                          fragments_col: str = "fragments", keep: tuple[str, ...] = ()) -> DataFrame:
    """T2 on the per-document form (name, fragments ARRAY<STRING>): row-wise, no shuffle.

    Output (name, *keep, pos, text, n_tokens, batch).  A trailing batch exists only
    if it holds tokens; a document with no fragments yields no rows.
    """
    limit = max_tokens - reserve
    with_tokens = docs.withColumn(
        "_tok", F.transform(F.col(fragments_col), lambda x: token_count(x)))
    with_ids = with_tokens.withColumn("_ids", let(
        _batch_ends(F.col("_tok"), limit), lambda ends: batch_ids(ends, F.size("_tok"))))
    rows = exploded(with_ids, F.arrays_zip(F.col(fragments_col).alias("text"), F.col("_tok").alias("n_tokens"),
                                           F.col("_ids").alias("batch")), "pos", "_f", "name", *keep)
    return rows.select(
        "name", *keep, F.col("pos").cast("bigint").alias("pos"), F.col("_f")["text"].alias("text"),
        F.col("_f")["n_tokens"].alias("n_tokens"),
        F.col("_f")["batch"].alias("batch"))


def document_batches(docs: DataFrame, max_tokens: int, reserve: int = RESERVE_TOKENS,
                     fragments_col: str = "fragments", keep: tuple[str, ...] = ()) -> DataFrame:
    """T2 as one row per batch: (name, *keep, batch, first, texts), row-wise; ``first`` is the position of texts[0]."""
    tokens = F.transform(F.col(fragments_col), lambda x: token_count(x))

    def batches(ends: Column) -> Column:
        def one(k: Column) -> Column:
            first = (F.coalesce(F.get(ends, k - F.lit(1)), F.lit(-1).cast("bigint")) + 1).cast("int")
            upto = F.coalesce(F.get(ends, k) + 1, F.size(fragments_col).cast("bigint")).cast("int")
            return F.struct(k.cast("bigint").alias("batch"), first.cast("bigint").alias("first"),
                            F.slice(fragments_col, first + 1, upto - first).alias("texts"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(ends)), one), lambda b: F.size(b["texts"]) > 0)

    rows = exploded(docs, let(_batch_ends(tokens, max_tokens - reserve), batches), "_i", "_b", "name", *keep)
    return rows.select("name", *keep, "_b.*")


def pack_batches(fragments: DataFrame, max_tokens: int, reserve: int = RESERVE_TOKENS,
                 fold_rows: int | None = None) -> DataFrame:
    """T2 on a fragments table (name, pos, text, n_tokens).

    Regroups each document and folds it in position order.  With ``fold_rows``
    the documents are counted first, and those with more fragments are packed
    by pointer doubling over many tasks (``packing``).
    """
    limit = max_tokens - reserve
    if fold_rows is not None:
        counts = fragments.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
        large = materialize(counts.filter(F.col("_n") > fold_rows).select("name"), "pack-large")
        many = large.count()
        if many:
            names = maybe_broadcast(large, many, NAME_BYTES)
            return pack_batches(fragments.join(names, "name", "left_anti"), max_tokens, reserve).unionByName(
                pack_large(fragments.join(names, "name", "left_semi"), limit))
    grouped = fragments.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "n_tokens"))).alias("_items"))
    ids = let(_batch_ends(F.transform(F.col("_items"), lambda x: x["n_tokens"]), limit),
              lambda ends: batch_ids(ends, F.size("_items")))
    batches = exploded(grouped, F.arrays_zip(F.transform("_items", lambda x: x["pos"]).alias("pos"),
                                             ids.alias("batch")), "_i", "_b", "name")
    return fragments.join(batches.select("name", "_b.pos", "_b.batch"), ["name", "pos"]).select(
        *fragments.columns, "batch")


def batch_totals(packed: DataFrame) -> DataFrame:
    """T3. Tokens and fragments per (name, batch), per name (batch NULL), and overall."""
    return (packed.rollup("name", "batch")
            .agg(F.sum("n_tokens").cast("bigint").alias("tokens"),
                 F.count(F.lit(1)).cast("bigint").alias("fragments"),
                 F.grouping_id().alias("level")))


def _document_cut(tokens: Column, budget: int) -> Column:
    """(run, kept, kept_tokens) of a document's fragments in order, by one fold."""
    zero = F.lit(0).cast("bigint")

    def step(acc, t):
        fits = acc["run"] <= F.lit(budget)
        return F.struct((acc["run"] + t).alias("run"),
                        (acc["kept"] + F.when(fits, 1).otherwise(0)).cast("bigint").alias("kept"),
                        (acc["kept_tokens"] + F.when(fits, t).otherwise(0)).cast("bigint").alias("kept_tokens"))

    return F.aggregate(tokens, F.struct(zero.alias("run"), zero.alias("kept"), zero.alias("kept_tokens")), step)


def _document_tokens(docs: DataFrame, fragments_col: str) -> DataFrame:
    return docs.select("name", F.transform(F.col(fragments_col), lambda x: token_count(x)).alias("_tok")).filter(
        F.size("_tok") > 0)


def cut_documents(docs: DataFrame, budget: int, fragments_col: str = "fragments") -> DataFrame:
    """T4 over whole documents (name, fragments): the kept prefix as (name, pos, n_tokens), row-wise, no shuffle."""
    cut = _document_tokens(docs, fragments_col).select(
        "name", F.slice("_tok", F.lit(1), _document_cut(F.col("_tok"), budget)["kept"].cast("int")).alias("_tok"))
    return exploded(cut, F.col("_tok"), "pos", "n_tokens", "name").withColumn("pos", F.col("pos").cast("bigint"))


def cut_document_report(docs: DataFrame, budget: int, fragments_col: str = "fragments") -> DataFrame:
    """T5 over whole documents (name, fragments), row-wise, no shuffle; no row for one without fragments."""
    found = _document_tokens(docs, fragments_col).select(
        "name", F.size("_tok").cast("bigint").alias("candidates"), _document_cut(F.col("_tok"), budget).alias("_c"))
    return found.select("name", "candidates", "_c.kept", "_c.kept_tokens",
                        (F.col("_c.kept") < F.col("candidates")).alias("was_cut"))


def _earlier_tokens(ranked: DataFrame, key: str, rank: str, tokens: str, chunked: bool) -> DataFrame:
    if chunked:
        return running_total(ranked, [key], rank, F.col(tokens), "_earlier")
    w = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("_earlier", F.coalesce(F.sum(tokens).over(w), F.lit(0)))


def cut_to_budget(ranked: DataFrame, key: str, budget: int, rank: str = "rank",
                  tokens: str = "n_tokens", chunked: bool = False) -> DataFrame:
    """T4. Keep the ranked prefix whose *earlier* rows fit the budget (inclusive cut).

    A row is kept iff the tokens of all rows ranked before it total at most
    ``budget``; the row that overflows is kept, later ones dropped.  For
    retrieval results a group holds at most the limit and one window is fine;
    ``chunked=True`` (unbounded groups, e.g. whole documents) uses the
    chunked running total so no task holds a whole group.
    """
    earlier = _earlier_tokens(ranked, key, rank, tokens, chunked)
    return earlier.filter(F.col("_earlier") <= budget).drop("_earlier")


def cut_report(ranked: DataFrame, key: str, budget: int, rank: str = "rank",
               tokens: str = "n_tokens", chunked: bool = False) -> DataFrame:
    """T5. Per group: candidates, fragments kept, tokens kept, and whether a cut happened."""
    flagged = _earlier_tokens(ranked, key, rank, tokens, chunked).withColumn(
        "_kept", F.col("_earlier") <= budget)
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("candidates"),
        F.sum(F.col("_kept").cast("int")).cast("bigint").alias("kept"),
        F.sum(F.when(F.col("_kept"), F.col(tokens)).otherwise(0)).cast("bigint").alias("kept_tokens"),
        F.max((~F.col("_kept")).cast("int")).cast("boolean").alias("was_cut"))
