"""Prompt tables, model-call hook, stream assembly and chat history.

Prompts are ARRAY<STRUCT<role, content>> columns.  The wording is our own.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import strip_ws, token_count
from docweave.functions.vectors import exploded
from docweave.plans.scan import dense_positions, running_total
from docweave.plans.sizing import materialize
from docweave.sources.index import path_exists

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


ANSWER_HEAD = ("Answer the question using only the numbered passages below, which are ordered from "
               "most to least relevant.\n<passages>\n")
ANSWER_TAIL = ("\n</passages>\nIf the passages do not contain the answer, say that the available "
               "context is not enough. Reply in {language}.")
SUMMARY_HEAD = ("These passages were taken from one document and are ordered from most to least "
                "representative:\n\n")
SUMMARY_TAIL = "\n\nWrite a summary of the whole document in {language}."
KEYWORD_HEAD = "List the keywords of the following question, separated by commas.\nQuestion: "
KEYWORD_TAIL = "\nKeywords:"


def answer_system_text(context: Column, language: str) -> Column:
    return F.concat(F.lit(ANSWER_HEAD), context, F.lit(ANSWER_TAIL.format(language=language)))


def answer_prompts(context: DataFrame, requests: DataFrame, language: str = "English") -> DataFrame:
    """P1. (request_id, messages): system message with the context, user message with the question."""
    joined = context.join(requests.select("request_id", "query"), "request_id")
    return joined.select("request_id", F.array(
        message("system", answer_system_text(F.col("context"), language)),
        message("user", F.col("query"))).alias("messages"))


def summary_prompts(context: DataFrame, language: str = "English") -> DataFrame:
    """P2. (name, messages): one system message listing the candidate passages."""
    text = F.concat(F.lit(SUMMARY_HEAD), F.col("context"), F.lit(SUMMARY_TAIL.format(language=language)))
    return context.select("name", F.array(message("system", text)).alias("messages"))


def keyword_prompts(requests: DataFrame) -> DataFrame:
    """P3. (request_id, messages): ask for comma-separated keywords of the question."""
    text = F.concat(F.lit(KEYWORD_HEAD), F.col("query"), F.lit(KEYWORD_TAIL))
    return requests.select("request_id", F.array(message("user", text)).alias("messages"))


def explode_messages(prompts: DataFrame, key: str) -> DataFrame:
    """Messages as rows (key, seq, role, content)."""
    return exploded(prompts, F.col("messages"), "seq", "_m", key).select(
        key, F.col("seq").cast("bigint").alias("seq"), F.col("_m")["role"].alias("role"),
        F.col("_m")["content"].alias("content"))


ChatFn = Callable[[list[list[dict]]], list[tuple[str, int, int]]]

COMPLETION_SCHEMA = T.StructType([
    T.StructField("reply", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
])


def complete(prompts: DataFrame, key: str, fn: ChatFn, model: str) -> DataFrame:
    """P4. Run a caller-supplied batch chat function over prompt rows.

    ``fn(list of message lists) -> list of (reply, prompt_tokens, completion_tokens)``
    is called per Arrow batch inside executors (``mapInPandas``).  Replies are
    trimmed; usage rows carry ``model`` for ``chat_cost``.  No client ships here.
    """
    key_field = prompts.schema[key]
    out_schema = T.StructType([key_field, T.StructField("model", T.StringType())] + COMPLETION_SCHEMA.fields)

    def run(batches):
        for pdf in batches:
            messages = [[{"role": m["role"], "content": m["content"]} for m in row]
                        for row in pdf["messages"]]
            results = fn(messages)
            yield pd.DataFrame({
                key: pdf[key].values,
                "model": model,
                "reply": [r[0].strip() for r in results],
                "prompt_tokens": [int(r[1]) for r in results],
                "completion_tokens": [int(r[2]) for r in results],
            })

    return prompts.select(key, "messages").mapInPandas(run, out_schema)


def complete_stored(prompts: DataFrame, key: str, fn: ChatFn, model: str, path: str, batch_tokens: int = 50_000,
                    batch_prompts: int = 200, wave_batches: int = 64) -> DataFrame:
    """P4 that can be repeated: ``complete`` with every reply kept in the folder ``path``.

    A request is its messages and the model; equal ones are asked once.  Those
    without a stored reply are cut into batches of about ``batch_tokens`` tokens
    and at most ``batch_prompts`` requests, one call of ``fn`` and one task each.
    Batches run in waves of ``wave_batches``, and a wave's replies are stored
    before the next starts: after a failure a repeated call pays again only for
    the wave that was open, and a lost task only for its batch.
    """
    spark = prompts.sparkSession
    request = F.sha2(F.concat_ws("\x00", F.lit(model), F.to_json("messages")), 256)
    asked = prompts.select(key, request.alias("request"), "messages")
    schema = T.StructType([T.StructField("request", T.StringType()), *COMPLETION_SCHEMA.fields])
    replies = f"{path.rstrip('/')}/replies"

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(replies) if path_exists(spark, replies) else \
            spark.createDataFrame([], schema)

    tokens = F.aggregate("messages", F.lit(0).cast("bigint"), lambda n, m: n + token_count(m["content"]))
    open_ = (asked.groupBy("request").agg(F.first("messages").alias("messages")).join(stored(), "request", "left_anti")
             .withColumn("weight", F.greatest(tokens, F.lit(-(-batch_tokens // batch_prompts)))))
    batched = running_total(open_, [], "request", F.col("weight"), "before").select(
        "request", "messages", F.floor(F.col("before") / batch_tokens).alias("batch"))
    batched = materialize(batched, "open-requests")

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        results = fn([[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf["messages"]])
        if len(results) != len(pdf):
            raise ValueError(f"the model function must return {len(pdf)} replies")
        return pd.DataFrame({"request": pdf["request"].values, "reply": [r[0].strip() for r in results],
                             "prompt_tokens": [int(r[1]) for r in results],
                             "completion_tokens": [int(r[2]) for r in results]})

    last = batched.agg(F.max("batch")).first()[0]
    for first in range(0, 0 if last is None else last + 1, wave_batches):
        wave = batched.filter(F.col("batch").between(first, first + wave_batches - 1))
        wave.groupBy("batch").applyInPandas(call, schema).write.mode("append").parquet(replies)
    # A reply stored twice (a wave whose store was announced as failed) counts once.
    known = stored().dropDuplicates(["request"])
    return asked.drop("messages").join(known, "request").select(
        key, F.lit(model).alias("model"), "reply", "prompt_tokens", "completion_tokens")


def assemble_stream(chunks: DataFrame, key: str = "reply_id", seq: str = "seq",
                    delta: str = "delta") -> DataFrame:
    """P5. Ordered chunks -> one trimmed string per reply; NULL chunks skipped.

    The result is one string per reply, so a group is bounded by its output.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(delta).alias("d"))))
    return (chunks.filter(F.col(delta).isNotNull()).groupBy(key)
            .agg(strip_ws(F.array_join(F.transform(parts, lambda x: x["d"]), "")).alias("reply")))


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """P6. (conv_id, turn, question, answer): a user turn directly followed by an assistant turn.

    Turn numbers may have gaps: turns are ranked first, in chunks, so that "next
    turn" is an equi-join on (conv_id, rank + 1) without a window over a whole
    conversation.  Of turns with one number the order is that of role and text.
    """
    ranked = materialize(dense_positions(conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn",
                                         out="_n", extra_order=["role", "text"]), "ranked-turns")
    users = ranked.filter(F.col("role") == "user").select(
        "conv_id", "turn", "_n", F.col("text").alias("question"))
    replies = ranked.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("_n") - 1).alias("_n"), F.col("text").alias("answer"))
    return users.join(replies, ["conv_id", "_n"]).drop("_n")


def clean_queries(requests: DataFrame) -> DataFrame:
    """F12. Trim questions, drop blank ones."""
    return requests.withColumn("query", strip_ws(F.col("query"))).filter(F.col("query") != "")


def split_keywords(keywords: Column) -> Column:
    """F16. "a, b ,c" -> ["a", "b", "c"] (trimmed items)."""
    return F.transform(F.split(keywords, ","), strip_ws)
