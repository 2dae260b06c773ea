"""Model catalog lookups and cost accounting.

The catalog tables are fixed and tiny (15 and 3 rows), so they are always
broadcast.  Usage of an unknown model is kept, with NULL costs and
``known_model`` false; naming an unknown model for all rows raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.constants import CHAT_MODELS, EMBEDDING_MODELS

CHAT_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("context_window", T.LongType(), False),
    T.StructField("input_price_per_k", T.DoubleType(), False),
    T.StructField("output_price_per_k", T.DoubleType(), False),
])
EMBEDDING_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("price_per_k", T.DoubleType(), False),
    T.StructField("max_tokens", T.LongType(), False),
    T.StructField("dimensions", T.LongType(), False),
])

COST_DECIMALS = 10


def model_catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """S8. (chat models, embedding models) as small DataFrames."""
    return (spark.createDataFrame(CHAT_MODELS, CHAT_SCHEMA),
            spark.createDataFrame(EMBEDDING_MODELS, EMBEDDING_SCHEMA))


def unknown_models(df: DataFrame, catalog: DataFrame, model_col: str = "model") -> DataFrame:
    """Rows naming a model that is not in the catalog."""
    return df.join(F.broadcast(catalog.select(F.col("model").alias(model_col))), model_col, "left_anti")


def _price(models: DataFrame, model: str, col: str):
    """Price of one model as a scalar subquery; an unknown model raises when the query runs."""
    price = models.filter(F.col("model") == model).agg(F.max(col)).scalar()
    return F.coalesce(price, F.raise_error(F.lit(f"unknown model {model}")).cast("double"))


def chat_cost(usage: DataFrame, chat_models: DataFrame, model: str | None = None) -> DataFrame:
    """T6. usage (…, model, prompt_tokens, completion_tokens) -> tokens and cost.

    cost = tokens / 1000 * price per 1k, input and output priced separately.
    With ``model`` every row is priced as that model (scalar lookups, no join);
    otherwise rows are joined to the broadcast catalog on their ``model``;
    rows of a model outside it stay, with NULL costs and ``known_model`` false.
    """
    if model is not None:
        priced = usage.withColumn("model", F.lit(model)).select(
            "*", _price(chat_models, model, "input_price_per_k").alias("input_price_per_k"),
            _price(chat_models, model, "output_price_per_k").alias("output_price_per_k"))
    else:
        priced = usage.join(F.broadcast(chat_models.select("model", "input_price_per_k",
                                                           "output_price_per_k")), "model", "left")
    input_cost = F.col("prompt_tokens") / 1000.0 * F.col("input_price_per_k")
    output_cost = F.col("completion_tokens") / 1000.0 * F.col("output_price_per_k")
    return (priced
            .withColumn("total_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint"))
            .withColumn("input_cost", F.round(input_cost, COST_DECIMALS))
            .withColumn("output_cost", F.round(output_cost, COST_DECIMALS))
            .withColumn("total_cost", F.round(input_cost + output_cost, COST_DECIMALS))
            .withColumn("known_model", F.col("input_price_per_k").isNotNull())
            .drop("input_price_per_k", "output_price_per_k"))


def embedding_cost(batches: DataFrame, embedding_models: DataFrame, model: str) -> DataFrame:
    """T7. Per-batch cost of embedding calls: batch tokens / 1000 * the model's price.

    ``batches`` has (name, batch, tokens); the result adds ``model`` and ``cost``.
    """
    price = _price(embedding_models, model, "price_per_k")
    return (batches.withColumn("model", F.lit(model))
            .withColumn("cost", F.round(F.col("tokens") / 1000.0 * price, COST_DECIMALS)))


def embedding_cost_totals(costs: DataFrame) -> DataFrame:
    """T7 (totals). Tokens and cost of each document (level 0) and of all (level 1, name NULL)."""
    return (costs.rollup("name").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.count(F.lit(1)).alias("batches"), F.round(F.sum("cost"), 9).alias("cost")))
